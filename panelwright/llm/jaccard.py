"""Near duplicates: PartEnum signatures over word shingles, parity sketches, and exact verification of whole sets."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitset import BitSet
from .store import fresh, materialize, read_table
from .words import mix, runs, signed, split, window_hashes

SHINGLE = 5
#: Link when DEN * intersection >= NUM * union, that is when the sets differ in at most (DEN - NUM) / (DEN + NUM) of the
#: sum of their sizes.
NUM, DEN = 3, 4
#: Size bands grow by GROW_NUM / GROW_DEN, at least by DEN / NUM, so that linked sets lie in one band or in two that touch.
GROW_NUM, GROW_DEN = 3, 2
#: Second level of PartEnum: each partition of the domain has SUB parts, and every subset of SUB - 1 of them is enumerated.
SUB = 3
#: Bits of a parity sketch for each shingle, at least: with one, sets that share less than two thirds of their shingles
#: are told apart, and larger sketches cost more room in the families than they save in whole sets.
SKETCH_BITS = 1
#: Leading bits of a signature that move; two that agree by chance only add candidates.
SIGNATURE_MASK = 0xFFFFFFFFFFFF0000
#: Verdicts on rows are broadcast up to this number (some 40 MB on an executor), and joined by shuffle beyond it.
BROADCAST_ROWS = 1 << 20
#: A task's block of a family: shingles and names, on average at most.
BLOCK_SHINGLES, BLOCK_NAMES = 1 << 20, 2048
U = np.uint64


def shingle_sets(words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and where each document starts (with one more entry)."""
    n_docs = len(words.first) - 1
    full = window_hashes(words.hash, SHINGLE)
    first = words.first.tolist()
    parts, ends = [], np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= SHINGLE:
            s = np.sort(full[a : b - SHINGLE + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        else:
            s = window_hashes(words.hash[a:b], b - a) if b > a else full[:0]
        parts.append(s)
        ends[d + 1] = ends[d] + len(s)
    return (np.concatenate(parts) if parts else full[:0]), ends


def _set_hashes(sets, ends):
    """One 64-bit name for each set; an empty one has the name 0."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(mix(sets ^ U(0xA5A5A5A5A5A5A5A5)))]).astype(np.uint64)
        n = np.diff(ends)
        return np.where(n > 0, mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64)) | U(1), U(0)), n


# ---- signatures


def size_bands(largest: int) -> np.ndarray:
    """Last size of each band."""
    lo, hi = 1, []
    while True:
        hi.append(lo * GROW_NUM // GROW_DEN)
        if hi[-1] >= largest:
            return np.array(hi)
        lo = hi[-1] + 1


def signatures(sets, ends) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) rows such that any two sets that link share one.

    An instance of a band takes sets of that band, and those of the next one that may link with them. It cuts the hash
    domain into partitions of SUB parts each. A pair with d differences has, among any floor(d / 2) + 1 partitions, one
    with at most one difference; so one of its subsets of SUB - 1 parts agrees. A set goes through the partitions in
    order until it has met one more than half the differences that it may have in which no subset is empty, and gives
    all subsets on the way that are not. Of two linked sets let one stop like that: one at least of the partitions in
    which none of its subsets is empty holds at most one difference, so they share a subset with shingles there, and the
    other one gives it too if it goes as far or, where it runs out of partitions, gives all that it has. Two sets that
    both run out (few shingles for the partitions) may have no such partition; so a set that does also gives its
    smallest shingles: of two linked sets one shingle at least is among the (n - ceil(n * NUM / DEN) + 1) smallest of both.
    """
    n = np.diff(ends)
    out_doc, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if not len(sets):
        return out_doc[0], out_sig[0]
    ran_out = np.zeros(len(n), bool)
    hi = size_bands(int(n.max()))
    band = np.searchsorted(hi, n)
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        mixed = mix(sets ^ U(0xA5A5A5A5A5A5A5A5))
    for role in (0, 1):  # as the smaller (or equal) set, in its own band; as the larger one, in the band below
        inst = band - role
        largest = hi[np.maximum(inst, 0)]
        live = (n > 0) & (inst >= 0) & ((role == 0) | (n * NUM <= largest * DEN))
        k = (n + (n * DEN // NUM if role == 0 else largest)) * (DEN - NUM) // (DEN + NUM)
        most = 2 * (largest * DEN // NUM) * (DEN - NUM) // (DEN + NUM)
        m = np.where(live, most // 2 + 1 + most // 10 + 1, 0)  # partitions of the instance, some to spare for empty ones
        pick = live[doc]
        d, h = doc[pick], sets[pick]
        if not len(d):
            continue
        off = np.concatenate([[0], np.cumsum(m)])
        cell = off[d] * SUB + (((h >> U(32)) * (m[d] * SUB).astype(np.uint64)) >> U(32)).astype(np.int64)  # ascending
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums, count = np.zeros(off[-1] * SUB, np.uint64), np.bincount(cell, minlength=off[-1] * SUB).reshape(-1, SUB)
        with np.errstate(over="ignore"):
            sums[cell[at]] = np.add.reduceat(mixed[pick], at)
            sums = sums.reshape(-1, SUB)
            owner = np.repeat(np.arange(len(n)), m)
            place = np.arange(len(owner)) - off[owner]
            where = mix((inst[owner].astype(np.uint64) << U(40)) + place.astype(np.uint64))
            left_out = np.arange(SUB, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
            sig = mix(sums.sum(axis=1)[:, None] - sums + where[:, None] + left_out)
        filled = count.sum(axis=1)[:, None] > count
        full = np.concatenate([[0], np.cumsum(filled.all(axis=1))])
        met = full[1:] - full[off[owner]]  # partitions without an empty subset, up to and with this one
        need = (k // 2 + 1)[owner]
        before = met - filled.all(axis=1) < need
        short = (full[off[1:]] - full[off[:-1]] < k // 2 + 1)[owner]
        keep = (before | short)[:, None] & filled
        out_doc.append(np.repeat(owner, keep.sum(axis=1)))
        out_sig.append(sig[keep])
        ran_out[owner[short]] = True
    few = np.where(ran_out, n - -(-n * NUM // DEN) + 1, 0)
    first = np.repeat(ends[:-1], few) + np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
    out_doc.append(np.repeat(np.arange(len(n)), few))
    with np.errstate(over="ignore"):
        out_sig.append(mix(sets[first] + U(0x9E3779B97F4A7C15)))
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _once(name: np.ndarray, sent: set) -> np.ndarray:
    """Which of the names (0: none) this task meets for the first time."""
    return np.array([x != 0 and x not in sent and not sent.add(x) for x in name.tolist()], bool)


def _signature_rows(batches):
    sent: set[int] = set()  # names of the sets of this task; equal sets go once
    for batch in batches:
        for _, offsets, data in runs(batch):
            sets, ends = shingle_sets(split(offsets, data, lower=True))
            name, n = _set_hashes(sets, ends)
            new = _once(name, sent)
            sets, n, name = sets[np.repeat(new, n)], n[new], name[new]
            doc, sig = signatures(sets, np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig & U(SIGNATURE_MASK))), pa.array(signed(name[doc]))], names=["sig", "name"])


# ---- sketches


def parity_sketch(members: np.ndarray) -> bytes:
    """Bit i: whether an odd number of members fall on i. Two sketches differ in at most as many bits as their sets in
    members, and folding one to half its size keeps that."""
    size = max(64, 1 << (SKETCH_BITS * len(members) - 1).bit_length())
    bits = np.bincount(((members >> U(8)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as 64-bit words, folded to `words` words."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _may_link(na, nb, gap):
    return (gap * (DEN + NUM) <= (na + nb) * (DEN - NUM)) & (na * DEN >= nb * NUM) & (nb * DEN >= na * NUM)


class Sketches:
    """Sketches of a group by size, each also at half its size: linked sets are within 4/3, their sketches within a factor of 2."""

    def __init__(self, n: np.ndarray, raw: list[bytes]):
        self.n = n.astype(np.int64)
        width = np.array([len(x) // 8 for x in raw])
        self.level = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            whole = np.stack([np.frombuffer(raw[k], np.uint64) for k in rows])
            self.level[w] = (rows, {w: whole} | ({w // 2: fold(whole, w // 2)} if w > 1 else {}))
        self.width, self.place = width, np.zeros(len(raw), np.int64)
        for rows, _ in self.level.values():
            self.place[rows] = np.arange(len(rows))

    def near(self, i: int, allowed: np.ndarray) -> np.ndarray:
        """Rows j of `allowed` (a mask) that may link with row i."""
        w, out = int(self.width[i]), []
        for v in (w // 2, w, 2 * w):
            if v in self.level:
                rows, at = self.level[v]
                small = min(v, w)
                pick = allowed[rows]
                if pick.any():
                    rows = rows[pick]
                    gap = np.bitwise_count(at[small][pick] ^ self.level[w][1][small][self.place[i]]).sum(axis=1, dtype=np.int64)
                    out.append(rows[_may_link(self.n[i], self.n[rows], gap)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _digests(batches):
    """A row for each document; the sketch only where the task meets the set for the first time."""
    sent: set[int] = set()
    for batch in batches:
        for rows, offsets, data in runs(batch):
            sets, ends = shingle_sets(split(offsets, data, lower=True))
            name, n = _set_hashes(sets, ends)
            sketch = [parity_sketch(sets[a:b]) if new else None for new, a, b in zip(_once(name, sent), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(signed(name)), pa.array(sketch, pa.binary())], names=["doc_id", "key", "n_shingles", "name", "sketch"])


# ---- whole sets


def _set_rows(wanted: BitSet):
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, offsets, data in runs(batch):
                sets, ends = shingle_sets(split(offsets, data, lower=True))
                name, n = _set_hashes(sets, ends)
                rows = np.flatnonzero(_once(np.where(wanted.may_hold(name), name, U(0)), sent))
                body = [(sets[ends[i] : ends[i + 1]] >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(signed(name[rows])), pa.array(body, pa.binary())], names=["name", "body"])

    return run


def whole_sets(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, body) of the written names: each set read again from its text. The filter by bits has a size bound."""
    rows = texts.mapInArrow(_set_rows(BitSet(names, "name")), "name long, body binary")
    return rows.join(names, "name", "left_semi").dropDuplicates(["name"])


def members_of(body: bytes) -> np.ndarray:
    """The leading 48 bits of each hash of a set, ascending."""
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(x) * DEN < len(y) * NUM:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return DEN * both >= NUM * (len(x) + len(y) - both)


# ---- families


def _leaders(table: pa.Table) -> pa.Table:
    """Each name of a block with the first earlier leader that it may link with; a name without one leads."""
    order = np.argsort(table.column("name").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    name = table.column("name").to_numpy()
    s = Sketches(table.column("n").to_numpy(), table.column("sketch").to_pylist())
    leads, a, b = np.zeros(len(name), bool), [], []
    for i in range(len(name)):
        near = s.near(i, leads)
        if len(near):
            a.append(name[near.min()])
            b.append(name[i])
        else:
            leads[i] = True
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _star_links(table: pa.Table) -> pa.Table:
    """The names of a group that link with its leader."""
    star, name, body = table.column("a")[0].as_py(), table.column("name").to_pylist(), table.column("body").to_pylist()
    lead = members_of(body[name.index(star)])
    hit = [x for x, y in zip(name, body) if x != star and linked(lead, members_of(y))]
    return pa.table({"a": pa.array([star] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})


def _crossing(table: pa.Table):
    """(row, rows of other classes that it may link with) in one pair of blocks."""
    label, block = (table.column(c).to_numpy() for c in ("label", "block"))
    s = Sketches(table.column("n").to_numpy(), table.column("sketch").to_pylist())
    one_block, later = table.column("i")[0].as_py() == table.column("j")[0].as_py(), np.ones(len(label), bool)
    for i in range(len(label)):
        later[i] = False
        near = s.near(i, later & (label != label[i]) & ((block != block[i]) | one_block))
        if len(near):
            yield i, near


def _open_names(table: pa.Table) -> pa.Table:
    """Names of a pair of blocks that may link with one of another class."""
    rows = np.zeros(table.num_rows, bool)
    for i, near in _crossing(table):
        rows[i] = rows[near] = True
    return table.select(["family", "i", "j", "block", "name", "label", "n", "sketch"]).filter(pa.array(rows))


def _crossing_links(table: pa.Table) -> pa.Table:
    """Links between classes of one pair of blocks: enough of them to join whatever links."""
    name, label, body = (table.column(c).to_pylist() for c in ("name", "label", "body"))
    sets: dict[int, np.ndarray] = {}
    top: dict[int, int] = {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    def members(k):
        if k not in sets:
            sets[k] = members_of(body[k])
        return sets[k]

    a, b = [], []
    for i, near in _crossing(table):
        for j in near.tolist():
            if root(label[i]) != root(label[j]) and linked(members(i), members(j)):
                top[root(label[i])] = root(label[j])
                a.append(name[i])
                b.append(name[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _parts(names, shingles):
    return F.greatest(F.ceil(names / BLOCK_NAMES), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def likely_links(families: DataFrame, texts: DataFrame, sketches: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between the names that stand for their classes in a family, each against one leader of its block;
    and the families of more than one block, whose leaders have not met."""
    at = families.join(labels, "name").groupBy("family", "label").agg(F.min_by("name", F.xxhash64("name", F.lit(turn))).alias("name"))
    at = materialize(at.join(sketches.select("name", "n"), "name").select("family", "name", "n"), "standing")
    size = at.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1").select("family", _parts(F.col("c"), F.col("s")).alias("parts"))
    dealt = at.join(size, "family").select("family", "name", F.pmod(F.xxhash64("name", F.lit(turn)), F.col("parts")).cast("int").alias("part")).join(sketches, "name")
    stars = materialize(dealt.groupBy("family", "part").applyInArrow(_leaders, "a long, b long").distinct(), "stars")
    named = stars.select("a", F.col("b").alias("name")).unionByName(stars.select("a", F.col("a").alias("name")).distinct())
    bodies = whole_sets(texts, materialize(named.select("name").distinct(), "star_names"))
    # a leader's names are dealt out again where they are many, each part with the leader
    many = stars.join(sketches.select(F.col("name").alias("b"), "n"), "b").groupBy("a").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    dealt = named.join(many, "a").withColumn("part", F.explode(F.when(F.col("name") == F.col("a"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")))))
    links = materialize(dealt.join(bodies, "name").groupBy("a", "part").applyInArrow(_star_links, "a long, b long"), "links")
    return links, materialize(size.filter("parts > 1").select("family"), "split_families")


def remaining_links(families: DataFrame, texts: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """Verified links that join all classes with a link between them: every pair of one family and two classes is looked at.

    The names of a family stand in blocks, and each pair of blocks is one task's group. Those of the family's largest
    class stand in blocks of their own, which meet the blocks of other classes and not each other. Sketches leave out
    most names before whole sets move; rows come out for names and for links that join classes, never for all pairs.
    """
    at = families.join(labels, "name").join(sketches.select("name", "n"), "name")
    classes = at.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = classes.groupBy("family").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "label")).alias("top")).filter(F.col("c") > F.col("top.c"))
    sizes = sizes.select("family", F.col("top.label").alias("top"), _parts(F.col("top.c"), F.col("top.s")).alias("own"), _parts(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rest"))
    of = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    in_top = F.col("label") == F.col("top")
    placed = at.join(sizes, "family").withColumn("block", F.when(in_top, of("own")).otherwise(F.col("own") + of("rest"))).withColumn("start", F.when(in_top, F.col("own")).otherwise(0))
    dealt = placed.select("family", "name", "label", "block", F.explode(F.expr("transform(sequence(start, own + rest - 1), j -> struct(least(block, j) as i, greatest(block, j) as j))")).alias("p"))
    schema = "family long, i int, j int, block int, name long, label long, n int, sketch binary"
    dealt = dealt.join(sketches, "name").select("family", "p.i", "p.j", "block", "name", "label", "n", "sketch")
    open_names = materialize(dealt.groupBy("family", "i", "j").applyInArrow(_open_names, schema), "open_names")
    bodies = whole_sets(texts, materialize(open_names.select("name").distinct(), "names"))
    return open_names.join(bodies, "name").groupBy("family", "i", "j").applyInArrow(_crossing_links, "a long, b long")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(name, label) after joining the labels of linked names; each class takes its smallest label."""
    of = lambda c: labels.select(F.col("name").alias(c), F.col("label").alias(f"l{c}"))
    edges = materialize(links.join(of("a"), "a").join(of("b"), "b").filter("la <> lb").select("la", "lb").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        near = materialize(both.groupBy("la").agg(F.least(F.first("la"), F.min("lb")).alias("to")), "near")
        jump = near.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.la")).select(F.col("x.la").alias("la"), F.col("y.to").alias("to"))
        jump = materialize(jump, "jump")
        labels = materialize(labels.join(jump.withColumnRenamed("la", "label"), "label", "left").select("name", F.coalesce("to", "label").alias("label")), "labels")
        for c in ("la", "lb"):
            edges = edges.join(jump.select(F.col("la").alias(c), F.col("to").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = materialize(edges.filter("la <> lb").distinct(), "edges")
    return labels


def set_classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written digest (doc_id, key, n_shingles, name, ...) of every row, and (name, label) of the names that meet others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    digest = materialize(rows.select("doc_id", "key", "text").mapInArrow(_digests, "doc_id long, key long, n_shingles long, name long, sketch binary"), "digest")
    texts = rows.select("text")
    by_sig = Window.partitionBy("sig")
    met = texts.mapInArrow(_signature_rows, "sig long, name long").select("name", F.min("name").over(by_sig).alias("family"), F.max("name").over(by_sig).alias("last"))
    families = materialize(met.filter("family < last").select("family", "name").distinct(), "families")
    labels = materialize(families.select("name").distinct().select("name", F.col("name").alias("label")), "labels")
    sketches = digest.filter("sketch is not null").select("name", F.col("n_shingles").cast("int").alias("n"), "sketch").join(labels, "name", "left_semi").dropDuplicates(["name"])
    sketches = materialize(sketches, "sketches")
    links, split_up = likely_links(families, texts, sketches, labels, 0)
    labels = merge_labels(labels, links)
    if not split_up.isEmpty():  # classes that stood in different blocks
        labels = merge_labels(labels, likely_links(families.join(split_up, "family", "left_semi"), texts, sketches, labels, 1)[0])
    labels = merge_labels(labels, materialize(remaining_links(families, texts, sketches, labels), "links"))
    return digest, labels


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Sets are the distinct 5-word shingles of the lower-cased words (all words as one shingle if fewer). A null, empty or
    blank text has the empty set and links with nothing. Equal sets are one node. component_id is the smallest doc_id
    reachable by links; a null doc_id counts only if its whole class has no other. Repeated rows stay.

    Shingles are 64-bit hashes, compared by 48 bits: a set of n shingles counts one too many with a chance of about
    n * n / 2^48, and a name stands for another set with one of 2^-63 for each pair.
    """
    digest, labels = set_classes(docs, text)
    own = digest.filter("n_shingles > 0")
    # copies are counted down to one row a name before they move
    low = own.groupBy("name").agg(F.min("doc_id").alias("low")).join(labels, "name", "left").select("name", "low", F.coalesce("label", "name").alias("label"))
    low = materialize(low, "low")
    best = low.groupBy("label").agg(F.min("low").alias("component_id"))
    ids = low.join(best, "label").select("name", "component_id")
    found = digest.join(ids, "name", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class of texts, that of the smallest doc_id (a null one last), with the columns of docs.

    Rows are told apart by doc_id and text, so rows of one doc_id with different texts fare by their texts; of rows
    equal in both one stays. Rows with the empty set all stay.
    """
    digest, labels = set_classes(docs, text)
    own = digest.filter("n_shingles > 0").select("doc_id", "key", "name")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    low = own.groupBy("name").agg(F.min(rank).alias("low")).join(labels, "name", "left").select("name", "low", F.coalesce("label", "name").alias("label"))
    low = materialize(low, "low")
    best = low.groupBy("label").agg(F.min("low").alias("best"))
    verdict = own.groupBy("name", "doc_id", "key").agg(F.count("*").alias("times")).join(low.join(best, "label").select("name", "best"), "name")
    stays = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("key") == F.col("best.key"))
    verdict = materialize(verdict.select("doc_id", "key", stays.alias("stays"), "times").filter("not stays or times > 1"), "verdicts")
    key, mark, i, k = (fresh(c, docs.columns) for c in ("key", "mark", "id", "hash"))
    marks = verdict.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.when(F.col("stays"), "one").otherwise("none").alias(mark))
    marks = F.broadcast(marks) if verdict.count() <= BROADCAST_ROWS else marks
    tagged = docs.withColumn(key, F.xxhash64(F.col(text).cast("string")))
    tagged = tagged.join(marks, (F.col("doc_id").cast("long").eqNullSafe(F.col(i))) & (F.col(key) == F.col(k)), "left")
    out = tagged.filter(F.col(mark).isNull())
    if not verdict.filter("stays").isEmpty():
        out = out.unionByName(tagged.filter(F.col(mark) == "one").dropDuplicates([i, k]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_partenum_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"


def components_oracle(relation: str) -> str:
    """DuckDB SQL: doc_id, n_shingles, component_id of the rows of `relation`."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') ws from {relation}),
s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) end)) sh from w),
n as (select doc_id, len(sh) k, sh from s),
one as (select min(doc_id) rep, sh, any_value(k) k from n where k > 0 group by sh),
x as (select rep, k, unnest(sh) g from one),
pair as (select a.rep a, b.rep b, count(*) o, any_value(a.k) ka, any_value(b.k) kb from x a join x b using (g) where a.rep < b.rep and a.k * {DEN} >= b.k * {NUM} and b.k * {DEN} >= a.k * {NUM} group by all),
link as (select a, b from pair where {DEN} * o >= {NUM} * (ka + kb - o)),
e as (select a, b from link union all select b, a from link),
walk(node, root) as (select rep, rep from one union select e.b, walk.root from walk join e on e.a = walk.node),
comp as (select node, min(root) c from walk group by node)
select n.doc_id, cast(n.k as bigint) n_shingles, coalesce(c, n.doc_id) component_id from n left join one using (sh) left join comp on comp.node = one.rep and n.k > 0"""


QUERIES = {"op5_partenum_join": op5_partenum_join}
ORACLES = {"op5_partenum_join": components_oracle("documents")}
