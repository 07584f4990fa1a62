"""SimHash near duplicates: vantage-point trees over fingerprints, dealt out as overlapping shards."""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import merge_labels
from .store import materialize, read_table
from .words import mix, runs, signed, split

SHINGLE, SEED, BITS = 4, 42, 64
#: Fingerprints link at so many differing bits or fewer.
REACH = 4
#: Each tree measures one part of the bits. Of two linked fingerprints one part at least differs in REACH // TREES bits or
#: fewer, and that tree finds them. Distances of whole fingerprints crowd around 32 +- 4 bits, where a triangle bound of
#: 4 prunes little; those of 21 bits around 10.5 +- 2.3, with a bound of 1.
TREES = 3
#: Home fingerprints of a shard, on average at most; the levels of the trees follow from it.
SHARD = 1 << 14
#: Fingerprints that visit a shard from other ones, in one task.
VISITORS = 1 << 20
#: Fingerprints of which the vantage points are chosen. The choice changes the balance of shards, never the pairs found.
SAMPLE = 4096
#: Bytes of text, and pairs of fingerprints, that a task works on at once.
RUN_BYTES, CELLS = 1 << 19, 1 << 18
#: Below this many home fingerprints a branch of a tree is compared with its queries one by one.
LEAF = 192
U = np.uint64


# ---- fingerprints


def shingle_hashes(words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of SHINGLE words (all words, if fewer) and how many each document has."""
    n_docs = len(words.first) - 1
    size = np.diff(words.first)
    if not len(words.doc):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    # one space after each word: its bytes and the separator next to it stay
    keep = np.zeros(len(data) + 1, np.int32)
    keep[words.start] += 1
    keep[words.end] -= 1
    inside = np.cumsum(keep[:-1]) > 0
    after = words.end[words.end < len(data)]
    space = after[~inside[after]]
    clean = data.copy()
    clean[space] = 0x20
    inside[space] = True
    place = np.concatenate([[0], np.cumsum(inside)])
    body = clean[inside].tobytes()
    last = np.minimum(np.arange(len(words.doc)) + SHINGLE, words.first[words.doc + 1]) - 1
    own = (words.pos() == 0) | (words.pos() + SHINGLE <= size[words.doc])
    lo, hi = place[words.start[own]].tolist(), place[words.end[last[own]]].tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, [body[a:b] for a, b in zip(lo, hi)], repeat(SEED)), np.uint64, len(lo))
    return h, np.bincount(words.doc[own], minlength=n_docs)


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of each document: the bits that over half of its hashes have; zero without hashes."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    ends = np.concatenate([[0], np.cumsum(count[full])])
    i = 0
    while i < len(full):  # some 2^16 hashes at a time; one longer document is added up in pieces
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 16), "right")) - 1)
        total = np.zeros((j - i, BITS), np.int64)
        for a in range(ends[i], ends[j], 1 << 16):
            b = min(a + (1 << 16), ends[j])
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += np.add.reduceat(bits, ends[i:j] - a, axis=0, dtype=np.int64) if j > i + 1 else bits.sum(axis=0, dtype=np.int64)
        bit = (2 * total > count[full[i:j], None]).astype(np.uint8)
        out[full[i:j]] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64).ravel()
        i = j
    return out


def _fingerprint_rows(batches):
    for batch in batches:
        for rows, offsets, data in runs(batch, limit=RUN_BYTES):
            w = split(offsets, data, lower=True, hashed=False)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signed(majority(*shingle_hashes(w, w.data))))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long. A text without words has the fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, fp long")


# ---- trees


def part_masks() -> np.ndarray:
    """TREES masks that cut the bits into parts of nearly equal length."""
    edge = [BITS * k // TREES for k in range(TREES + 1)]
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])], np.uint64)


def vantage_points(sample: np.ndarray, levels: int) -> list[tuple[np.uint64, list[tuple[np.uint64, int]]]]:
    """For each tree its mask and, for each level, a vantage point and the distance up to which fingerprints stand on the
    near side: the median of the sample. Next comes the point whose distances to the earlier ones are nearest to half of
    the bits, as sides of such points tell most from each other. All nodes of a level share its point."""
    out = []
    for mask in part_masks():
        half, points = int(mask).bit_count() / 2, []
        worst = np.zeros(len(sample))
        for _ in range(levels):
            v = sample[int(worst.argmin())]
            d = np.bitwise_count((sample ^ v) & mask)
            points.append((v, int(np.median(d))))
            worst = np.maximum(worst, np.abs(d - half))
        out.append((mask, points))
    return out


def cells(fp: np.ndarray, mask, points, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for each cell that fingerprints within `reach` of a row's may stand in.

    At each level the triangle bound says that a fingerprint near to one at distance d stands at d - reach to d + reach;
    a row whose range crosses the boundary goes to both sides. Of two cells the row visits the one that comes later in
    the order of their mixed codes, so each pair meets in one place.
    """
    row, cell, home = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.uint64)
    for v, radius in points:
        d = np.bitwise_count((fp ^ v) & mask).astype(np.int64)
        far = d > radius
        home = home * U(2) + far
        both = np.where(far, d - reach <= radius, d + reach > radius)[row]
        side = far[row]
        row, cell = np.concatenate([row, row[both]]), np.concatenate([cell * U(2) + side, cell[both] * U(2) + ~side[both]])
    with np.errstate(over="ignore"):
        ahead = mix(cell + U(1)) >= mix(home + U(1))[row]
    return row[ahead], cell[ahead], (cell == home[row])[ahead]


def _route(trees, reach: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(i, 4096).to_numpy().view(np.uint64)
                for t, (mask, points) in enumerate(trees):
                    row, cell, home = cells(fp, mask, points, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(signed(cell)), pa.array(home), pa.array(signed(fp[row]))], names=["tree", "cell", "home", "fp"])

    return run


class _Classes:
    """Classes of the fingerprints of one task that its links join."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.top = fp, np.arange(len(fp))

    def _flatten(self):
        while (up := self.top[self.top] != self.top).any():
            self.top[up] = self.top[self.top[up]]

    def join(self, a: np.ndarray, b: np.ndarray):
        """Join a[k] with b[k] for all k: round by round, each class along its first link to another one."""
        while True:
            ca, cb = self.top[a], self.top[b]
            apart = ca != cb
            if not apart.any():
                return
            a, b, ca, cb = a[apart], b[apart], ca[apart], cb[apart]
            high, first = np.unique(np.maximum(ca, cb), return_index=True)
            self.top[high] = np.minimum(ca, cb)[first]  # always downwards, so no ring comes about
            self._flatten()

    def compare(self, home: np.ndarray, query: np.ndarray):
        step = max(1, CELLS // max(len(query), 1))
        for k in range(0, len(home), step):
            h = home[k : k + step]
            i, j = np.nonzero(np.bitwise_count(self.fp[h][:, None] ^ self.fp[query][None]) <= REACH)
            self.join(h[i], query[j])

    def search(self, home: np.ndarray, query: np.ndarray, mask, reach: int):
        """Meet all pairs of a home and a query fingerprint that link and differ in at most `reach` bits of the mask."""
        todo = [(home, query)]
        while todo:
            home, query = todo.pop()
            if not len(query) or not len(home):
                continue
            if len(home) <= LEAF:
                self.compare(home, query)
                continue
            v = self.fp[home[len(home) // 2]]
            d = np.bitwise_count((self.fp[home] ^ v) & mask).astype(np.int64)
            radius = int(np.median(d))
            radius -= radius == d.max()
            near = d <= radius
            if not near.any():  # all at one distance from one of them: they agree in these bits
                self.compare(home, query)
                continue
            q = np.bitwise_count((self.fp[query] ^ v) & mask).astype(np.int64)
            todo += [(home[near], query[q <= radius + reach]), (home[~near], query[q > radius - reach])]


def _meet(masks: np.ndarray, reach: int):
    def run(table: pa.Table) -> pa.Table:
        home, fp = table.column("home").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fp, kind="stable")
        home, fp = home[order], fp[order]
        found = _Classes(fp)
        own, first = np.flatnonzero(home), table.column("j")[0].as_py() == 0
        query = np.arange(len(fp)) if first else np.flatnonzero(~home)
        found.search(own, query, masks[table.column("tree")[0].as_py()], reach)
        moved = np.flatnonzero(found.top != np.arange(len(fp)))
        return pa.table({"a": pa.array(signed(fp[moved])), "b": pa.array(signed(fp[found.top[moved]]))})

    return run


def shard_links(fps: DataFrame, shard: int = SHARD, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) that join the linked fingerprints of the written table fps(fp), each distinct.

    Home fingerprints of a shard search its tree, and those that the triangle bounds send over a boundary visit it. A
    shard with more homes than `shard` on four times the average, or more visitors than `visitors`, is dealt out in
    blocks that meet pair by pair: a dense group costs more tasks, never a larger one.
    """
    n = fps.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    reach, trees = REACH // TREES, vantage_points(sample, levels)
    routed = materialize(fps.mapInArrow(_route(trees, reach), "tree int, cell long, home boolean, fp long"), "routed")
    h, v = F.count(F.when(F.col("home"), 1)), F.count(F.when(~F.col("home"), 1))
    size = routed.groupBy("tree", "cell").agg(h.alias("h"), v.alias("v")).withColumn("p", F.ceil(F.col("h") / (4 * shard)).cast("int"))
    size = size.withColumn("q", F.ceil((F.col("v") + F.when(F.col("p") > 1, F.col("h")).otherwise(0)) / visitors).cast("int"))
    big = materialize(size.filter("p > 1 or q > 1").select("tree", "cell", F.greatest("p", F.lit(1)).alias("p"), F.greatest("q", F.lit(1)).alias("q")), "big_shards")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    dealt = routed.join(big, ["tree", "cell"], "left").withColumn("p", one("p")).withColumn("q", one("q")).withColumn("i", part("p", 0)).withColumn("j", part("q", 1))
    span = lambda a, b: F.sequence(a, b)
    pair = lambda i, j, home: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), home.alias("home"))
    as_home = F.transform(span(F.lit(0), F.col("q") - 1), lambda j: pair(F.col("i"), j, F.lit(True)))
    # homes of one block are queries of the later blocks, so two blocks meet once
    later = F.when(F.col("i") + 1 < F.col("p"), F.transform(span(F.col("i") + 1, F.col("p") - 1), lambda i: pair(i, F.col("j"), F.lit(False)))).otherwise(F.expr("array()"))
    visit = F.transform(span(F.lit(0), F.col("p") - 1), lambda i: pair(i, F.col("j"), F.lit(False)))
    dealt = dealt.select("tree", "cell", "fp", F.explode(F.when(F.col("home"), F.concat(as_home, later)).otherwise(visit)).alias("x")).select("tree", "cell", "x.i", "x.j", "x.home", "fp")
    return dealt.groupBy("tree", "cell", "i", "j").applyInArrow(_meet(part_masks(), reach), "a long, b long")


def hamming_classes(fps: DataFrame, shard: int = SHARD, visitors: int = VISITORS) -> DataFrame:
    """(name, label) of the fingerprints of the written table fps(fp) that link with another: label is their class."""
    links = materialize(shard_links(fps, shard, visitors).distinct(), "hamming_links")
    names = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    return merge_labels(materialize(names.select("name", F.col("name").alias("label")), "names"), links)


def simhash_classes(docs: DataFrame, text: str = "text", shard: int = SHARD, visitors: int = VISITORS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Words are lower-cased (A-Z); texts of fewer than four words are one shingle. A null, empty or blank text has the
    fingerprint zero and links like any other. Equal fingerprints are one node of the search, so a text with a third of
    all rows is one. component_id is the smallest doc_id reachable; a null doc_id counts only if its whole class has no
    other. Repeated rows stay, an empty table gives none, and other columns are not read.
    """
    digest = materialize(fingerprints(docs, text), "fingerprints")
    low = materialize(digest.groupBy("fp").agg(F.min("doc_id").alias("low")), "low")
    labels = hamming_classes(low.select("fp"), shard, visitors)
    # only fingerprints with a link meet their class; most have none
    named = materialize(low.join(labels, F.col("fp") == F.col("name")).select("fp", "low", "label"), "named")
    best = named.groupBy("label").agg(F.min("low").alias("best"))
    ids = low.join(named.join(best, "label").select("fp", "best"), "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id"))
    return digest.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vantage_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents; null texts count as empty."""
    return simhash_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_vantage_simhash": op11_vantage_simhash}
#: XXH64 with a seed has no form in SQL.
ORACLES: dict = {}
