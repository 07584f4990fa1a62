"""Source divergence audit: map tasks fold whole documents into stripes term -> (document frequency, counts by source),
stripes are merged by key, and the merged ones emit the divergences of sources."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, read_table
from .words import runs, signed, split

#: A language keeps the terms of at least so many of its documents.
MIN_DOCS = 3
SCALE = 1_000_000_000
#: Ranks of the report of terms.
TOP = 200
#: Entries (term, source) that wait to be folded, and that a task holds before it spills its stripes.
PENDING, HELD = 1 << 19, 1 << 20
#: Stripes of terms in at least one of so many documents of a spill meet first in SALTS parts, then as one.
HOT_SHARE, SALTS = 50, 64
#: Pairs of sources that are worked on at once.
CELLS = 1 << 20
_STOPS = np.ones(256, bool)
_STOPS[65:91] = _STOPS[97:123] = _STOPS[128:] = False
_STRIPE = "lang string, term string, salt int, df long, sources array<string>, counts array<long>"


def _sum_by(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys, the last one sorted first, and the sums of the values of each."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


class _Stripes:
    """Stripes of one task."""

    def __init__(self, salt: int):
        self.salt = salt
        self.clear()

    def clear(self):
        self.group: dict[tuple[str, str], int] = {}
        self.term: dict[int, bytes] = {}
        self.parts, self.waiting, self.held, self.docs = [], 0, 0, 0

    def add(self, groups: list[tuple[str, str]], words):
        """Fold whole documents, given the language and source of each."""
        self.docs += len(groups)
        code = np.array([self.group.setdefault(g, len(self.group)) for g in groups], np.int64)
        if not len(words.hash):
            return
        u, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        key = np.sort(words.doc * len(u) + inverse)  # one entry for each document and term
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        doc, term = np.divmod(key[at], len(u))
        (both,), (count, df) = _sum_by((code[doc] * len(u) + term,), (np.diff(np.append(at, len(key))), np.ones(len(at), np.int64)))
        g, t = np.divmod(both, len(u))
        for h, i in zip(u.tolist(), first.tolist()):
            if h not in self.term:
                self.term[h] = words.data[words.start[i] : words.end[i]].tobytes()
        self.parts.append((g, u[t], count, df))
        self.waiting += len(g)
        if self.waiting >= PENDING:
            self.fold()

    def fold(self):
        g, h, count, df = (np.concatenate(x) for x in zip(*self.parts))
        (g, h), (count, df) = _sum_by((g, h), (count, df))
        self.parts, self.waiting, self.held = [(g, h, count, df)], 0, len(g)

    def spill(self):
        """Rows of all stripes; afterwards there are none."""
        if self.parts:
            self.fold()
            g, h, count, df = self.parts[0]
            names = list(self.group)
            langs = sorted({x for x, _ in names})
            lang = np.array([langs.index(x) for x, _ in names])[g]
            order = np.lexsort((g, h, lang))
            g, h, count, df, lang = (x[order] for x in (g, h, count, df, lang))
            at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])))
            ends = np.append(at, len(g))
            total = np.add.reduceat(df, at)
            source = pa.array([s for _, s in names], pa.string()).take(pa.array(g))
            yield pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()).take(pa.array(lang[at])), pa.array([self.term[x].decode() for x in h[at].tolist()], pa.string()),
                pa.array(np.where(total * HOT_SHARE >= self.docs, self.salt, 0).astype(np.int32)), pa.array(total),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), source), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(count)),
            ], names=["lang", "term", "salt", "df", "sources", "counts"])
        self.clear()


def _stripe_rows(batches):
    stripes = _Stripes(1 + TaskContext.get().partitionId() % SALTS)
    for batch in batches:
        for rows, offsets, data in runs(batch):
            stripes.add(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), split(offsets, data, lower=True, stops=_STOPS))
            if stripes.held >= HELD:
                yield from stripes.spill()
    yield from stripes.spill()


def _merged(table: pa.Table) -> tuple[pa.RecordBatch, int]:
    """Stripes in the order of their keys, equal keys made one; and where the last one begins."""
    table = table.combine_chunks()
    cols = {n: table.column(n).combine_chunks() for n in table.schema.names}
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        differ = [pc.not_equal(cols[k][1:], cols[k][:-1]).to_numpy(zero_copy_only=False) for k in ("lang", "term", "salt")]
        new[1:] = np.logical_or.reduce(differ)
    at = np.flatnonzero(new)
    sizes = pc.list_value_length(cols["sources"]).to_numpy()
    source = pc.list_flatten(cols["sources"]).dictionary_encode()
    run = np.repeat(np.cumsum(new) - 1, sizes)
    (run, code), (count,) = _sum_by((run, source.indices.to_numpy().astype(np.int64)), (pc.list_flatten(cols["counts"]).to_numpy(),))
    order = np.lexsort((code, run))
    ends = pa.array(np.searchsorted(run[order], np.arange(len(at) + 1)), pa.int32())
    keys = [cols[k].take(pa.array(at)) for k in ("lang", "term", "salt")]
    df = pa.array(np.add.reduceat(cols["df"].to_numpy(), at))
    return pa.RecordBatch.from_arrays([*keys, df, pa.ListArray.from_arrays(ends, source.dictionary.take(pa.array(code[order]))), pa.ListArray.from_arrays(ends, pa.array(count[order]))], names=["lang", "term", "salt", "df", "sources", "counts"]), len(at) - 1


def _merge_rows(batches):
    """One pass over sorted stripes; only the last key is held from batch to batch."""
    held = None
    for batch in batches:
        if batch.num_rows:
            whole, last = _merged(pa.Table.from_batches([batch] if held is None else [held.cast(batch.schema), batch]))
            yield whole.slice(0, last)
            held = whole.slice(last)
    if held is not None:
        yield held


def merge_stripes(stripes: DataFrame) -> DataFrame:
    keys = ["lang", "term", "salt"]
    return stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_rows, _STRIPE)


def term_stripes(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The written stripes (lang, term, df, sources, counts) of the terms in at least min_docs documents of a language."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).cast("string").alias("text"))
    spilled = materialize(rows.mapInArrow(_stripe_rows, _STRIPE), "spilled")
    # a term of most documents has a stripe from every task: those meet in parts first
    hot = merge_stripes(spilled.filter("salt > 0")).withColumn("salt", F.lit(0))
    merged = merge_stripes(spilled.filter("salt = 0").unionByName(hot)).filter(F.col("df") >= min_docs)
    return materialize(merged.drop("salt"), "stripes")


# ---- what merged stripes emit


def rate(count: str, total: str) -> str:
    """SQL of 1 + floor(SCALE * (count + 1) / total): three digits at a time, so that totals up to 9e15 stay exact."""
    total, left, out = f"nullif({total}, 0)", f"({count} + 1)", "0L"
    for _ in range(3):
        out, left = f"({out} * 1000 + {left} * 1000 div {total})", f"({left} * 1000 % {total})"
    return f"(1 + {out})"


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q) * (p - q) / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def group_totals(docs: DataFrame, stripes: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The written (lang, source, n, v, ln, zero) of every group: occurrences of kept terms there, kept terms and
    occurrences of the language, and the rate of a term that the group lacks (null if the language keeps no term)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang).alias("lang"), name(source).alias("source")).distinct()
    entry = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("c"))
    n = entry.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ln"))
    out = groups.join(n, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "ln"])
    return materialize(out.withColumn("zero", F.expr(rate("0L", "n + v"))), "groups")


def _pair_rows(batches):
    """Folds, over stripes with the rates of their sources, what pairs of sources that both have a term add to the sum
    beyond what each adds alone; a row for each pair and task, or for each spill."""
    code: dict[tuple[str, str], int] = {}
    parts, held = [], 0

    def spill():
        if parts:
            (a, b), (value,) = _sum_by(tuple(np.concatenate(x) for x in list(zip(*parts))[:2]), (np.concatenate([x[2] for x in parts]),))
            names = list(code)
            lang, source = pa.array([x for x, _ in names], pa.string()), pa.array([y for _, y in names], pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(a)), source.take(pa.array(a)), source.take(pa.array(b)), pa.array(value)], names=["lang", "source", "item", "value"])
        parts.clear()

    for batch in batches:
        lang = batch.column(0).to_pylist()
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = batch.column(1).flatten()
        source, p, zero = flat.field(0).to_pylist(), flat.field(1).to_numpy(), flat.field(2).to_numpy()
        own = np.array([code.setdefault((x, y), len(code)) for x, y in zip(np.repeat(np.array(lang, object), size).tolist(), source)], np.int64)
        start, span = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        ends = np.concatenate([[0], np.cumsum(span)])
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CELLS, "right")) - 1)
            a = np.repeat(np.arange(i, j), span[i:j])
            b = start[a] + np.arange(len(a)) - (ends[a] - ends[i])
            a, b = a[a != b], b[a != b]
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            (ca, cb), (value,) = _sum_by((own[a], own[b]), (value,))
            parts.append((ca, cb, value))
            held += len(ca)
            i = j
            if held > CELLS:
                yield from spill()
                held = 0
    yield from spill()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language stands from the others and from the whole.

    Terms are runs of letters (A-Z in lower case, and all beyond ASCII); a language keeps those of at least min_docs of
    its documents. Part `pair`: for each other source, the sum over the kept terms of floor((p - q)^2 / q). Part `term`:
    the kept terms that the source has more often than its language, up to `top` of them. Null texts, languages and
    sources count as ''; repeated rows are documents of their own; an empty table gives none; a language without kept
    terms gives pairs of value 0. Only text, lang and source are read.

    No stripe is spread over all sources: sources that lack a term add the rate of a count of 0, which is summed from
    each source's histogram of rates. Stripes fold their pairs inside tasks, so what moves is a row a pair and task.
    """
    stripes = term_stripes(docs, min_docs, text, lang, source)
    groups = group_totals(docs, stripes, lang, source)
    entry = stripes.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("lc"), F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    entry = entry.select("lang", "term", "lc", F.col("e.sources").alias("source"), F.col("e.counts").alias("c"))
    entry = entry.join(groups, ["lang", "source"]).withColumn("p", F.expr(rate("c", "n + v"))).withColumn("q", F.expr(rate("lc", "ln + v")))

    best = entry.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    shared = entry.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("e")).filter(F.size("e") > 1)
    both = shared.select("lang", "e").mapInArrow(_pair_rows, "lang string, source string, item string, value long")
    # rates of one source against the zero of another, in both directions
    rates = materialize(entry.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("k")), "rates")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    met = rates.join(other, "lang").filter("source <> item")
    alone = met.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"k * ({gap('p', 'other')} - {gap('zero', 'other')})")).alias("from_p"), F.sum(F.expr(f"k * ({gap('other', 'p')} - {gap('other', 'zero')})")).alias("from_q"))
    alone = materialize(alone, "alone")
    base = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"coalesce(v * {gap('zero', 'other')}, 0L)").alias("value"))
    value = base.unionByName(alone.select("lang", "source", "item", F.col("from_p").alias("value"))).unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("from_q").alias("value"))).unionByName(both)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return terms.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def op12_divergence_stripes(spark, sf_dir: str) -> DataFrame:
    """All documents; null texts, languages and sources count as ''."""
    return audit(read_table(spark, sf_dir, "documents"))


_T = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES = {"op12_divergence_stripes": rf"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '{_T}')) term from d),
kept as (select lang, term from w group by all having count(distinct r) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) v from kept group by lang),
a as (select g.lang, g.source, kept.term, coalesce(n, 0) n from g join kept using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + ({SCALE}::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) p from a join v using (lang)),
l as (select lang, term, sum(n) n from a group by all),
q as (select lang, term, 1 + ({SCALE}::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) q from l join v using (lang)),
s as (select x.lang, x.source, y.source item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) value from p x join p y using (lang, term) where x.source <> y.source group by all),
pairs as (select x.lang, x.source, 'pair' part, y.source item, coalesce(value, 0) value from g x join g y using (lang) left join s on s.lang = x.lang and s.source = x.source and s.item = y.source where x.source <> y.source),
terms as (select lang, source, 'term' part, term item, ((p - q) * (p - q)) // q value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from (from pairs union all from terms))
select lang, source, part, item, cast(value as bigint) value, cast(rank as integer) rank from ranked where part = 'pair' or rank <= {TOP}"""}
QUERIES = {"op12_divergence_stripes": op12_divergence_stripes}
