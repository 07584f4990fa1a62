"""Cross-document line frequency: lines that too many documents of a host share go, and documents that are left bare go."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize, read_table
from .words import mix, runs, signed, split, window_hashes

MIN_WORDS = 10
#: A line is boilerplate when more than LINE_DOCS and more than LINE_SHARE of a host's distinct documents have it.
LINE_DOCS = 30
LINE_SHARE = 0.05
#: A document is depleted when fewer than MIN_WORDS words or less than this share of them stand outside such lines.
LEFT_SHARE = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PROFILE = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>"


def _repeat_words(words) -> np.ndarray:
    """Per document, the words inside 5-word windows that it has twice or more."""
    n, out = len(words.doc), np.zeros(len(words.first) - 1, np.int64)
    if n < 5:
        return out
    win = window_hashes(words.hash, 5)
    own = words.doc[: n - 4] == words.doc[4:]
    at = np.flatnonzero(own)
    with np.errstate(over="ignore"):
        key = mix(win[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    edges = np.zeros(n + 1, np.int64)
    starts = at[order[same]]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return np.bincount(words.doc[np.cumsum(edges[:-1]) > 0], minlength=len(out)).astype(np.int64)


def _lines(words, offsets) -> tuple[np.ndarray, ...]:
    """(document, hash of the line's exact bytes, hash of its lower-cased words, number of words) of each line with a word."""
    data = words.data
    cut = np.zeros(len(data) + 1, np.int64)
    cut[offsets[1:-1]] = 1
    breaks = data == 10
    line = np.cumsum(breaks)  # a line break ends its own line
    line_of = line[words.start] + np.cumsum(cut)[words.start]
    new = np.ones(len(line_of), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(line_of))
    return words.doc[first], first, last


def profile(batches):
    """One row per document: base figures, a hash of its words and, for each line with a word, a hash and its words."""
    for batch in batches:
        for rows, offsets, data in runs(batch):
            n_docs = rows.num_rows
            w = split(offsets, data)
            low = split(offsets, data, lower=True)
            lead = (data & 0xC0) != 0x80
            chars = np.concatenate([[0], np.cumsum(lead)])
            word_chars = np.bincount(w.doc, weights=chars[w.end] - chars[w.start], minlength=n_docs).astype(np.int64)
            sym = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
            with np.errstate(over="ignore"):
                doc, first, last = _lines(low, offsets)
                place = np.arange(len(low.hash)) - np.repeat(first, last - first) if len(first) else np.zeros(0, np.int64)
                step = mix(low.hash + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                norm = mix(np.add.reduceat(step, first)) if len(first) else np.zeros(0, np.uint64)
                pos = mix(low.hash + low.pos().astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                text_hash = np.zeros(n_docs, np.uint64)
                np.add.at(text_hash, low.doc, pos)
                text_hash = mix(text_hash + np.diff(low.first).astype(np.uint64))
            # equality of whole lines, bytes between line breaks, for n_dup_lines
            stops = np.flatnonzero(data == 10)
            lo, hi = _line_bytes(w.start[first], offsets, doc, stops, len(data))
            exact = np.fromiter((hash(data[a:b].tobytes()) for a, b in zip(lo, hi)), np.int64, len(lo)).view(np.uint64)
            seen = np.stack([doc.astype(np.uint64), exact]) if len(doc) else np.zeros((2, 0), np.uint64)
            dup = np.ones(len(doc), bool)
            if len(doc):
                order = np.lexsort((np.arange(len(doc)), exact, doc))
                s = seen[:, order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (s[:, 1:] != s[:, :-1]).any(axis=0)
                dup[order] = ~fresh
            n_words = np.diff(w.first)
            ends = np.searchsorted(doc, np.arange(n_docs + 1))
            names = rows.schema.names
            yield pa.RecordBatch.from_arrays([
                rows.column(names.index("doc_id")).cast(pa.int64()), rows.column(names.index("host")).cast(pa.string()), pa.array(signed(text_hash)), pa.array(n_words), pa.array(word_chars), pa.array(sym[offsets[1:]] - sym[offsets[:-1]]),
                pa.array(np.bincount(doc[dup], minlength=n_docs).astype(np.int64)), pa.array(_repeat_words(w)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(norm))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((last - first).astype(np.int32))),
            ], names=[f.split()[0] for f in _PROFILE.split(", ")])


def _line_bytes(at, offsets, doc, stops, end):
    """Byte range of the line around each position, within its document."""
    k = np.searchsorted(stops, at)
    before = np.where(k > 0, stops[np.maximum(k - 1, 0)] + 1, 0) if len(stops) else np.zeros(len(at), np.int64)
    after = np.where(k < len(stops), stops[np.minimum(k, max(len(stops) - 1, 0))], end) if len(stops) else np.full(len(at), end)
    return np.maximum(before, offsets[doc]), np.minimum(after, offsets[doc + 1])


def profiles(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The written table of document profiles; reads id, text and host alone."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(profile, _PROFILE).withColumn("host", F.coalesce("host", F.lit(""))), "profiles")


def frequent_lines(prof: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line_hash, n_docs) of lines above both limits; equal texts of a host count as one document.

    A host has at most (its lines / line_docs) of them. Distinct counting deals rows by (host, line, text), so that a
    line or host with a third of the rows still spreads.
    """
    hosts = prof.groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    lines = prof.select("host", "text_hash", F.explode(F.array_distinct("line_hashes")).alias("line_hash"))
    counts = lines.groupBy("host", "line_hash").agg(F.count_distinct("text_hash").alias("n_docs")).filter(F.col("n_docs") > line_docs)
    return materialize(counts.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * line_share).select("host", "line_hash", "n_docs"), "frequent_lines")


def verdicts(prof: DataFrame, frequent: DataFrame, min_words: int = MIN_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per profile: base figures, words in frequent lines, base_failed, kept."""
    texts = prof.select("host", "text_hash", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select("host", "text_hash", F.col("l.line_hashes").alias("line_hash"), F.col("l.line_words").alias("k"))
    # equal texts of a host have equal lines: each is looked up once
    once = texts.groupBy("host", "text_hash", "line_hash").agg(F.first("k").alias("k"), F.count("*").alias("times"))
    copies = prof.groupBy("host", "text_hash").agg(F.count("*").alias("copies"))
    lost = (
        once.join(frequent, ["host", "line_hash"]).join(copies, ["host", "text_hash"])
        .groupBy("host", "text_hash").agg(F.sum(F.col("k") * F.col("times") / F.col("copies")).cast("long").alias("n_line_words"))
    )
    out = prof.drop("line_hashes", "line_words").join(lost, ["host", "text_hash"], "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    bare = (left < min_words) | (left < F.col("n_words") * left_share)
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~bare)


def _strip(batches):
    """Texts without the lines whose hash the list in the row's last column names; the other columns as they come."""
    for batch in batches:
        names = batch.schema.names[:-1]
        bad, texts = batch.column(len(names)).to_pylist(), batch.column(names.index("text")).to_pylist()
        for i, (b, t) in enumerate(zip(bad, texts)):
            if b and t:
                drop, kept = set(b), []
                parts = t.split("\n")
                arr = pa.array(parts, pa.string())
                row = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(parts), np.int64)), pa.array([""] * len(parts)), arr], names=["doc_id", "host", "text"])
                for p, h in zip(parts, (x for r in profile([row]) for x in r.column(8).to_pylist())):
                    if not (h and h[0] in drop):
                        kept.append(p)
                texts[i] = "\n".join(kept)
        yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names))], names=names)


def quality_verdicts(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Base figures and verdict of every row of docs.

    A document's lines are its \\n-split lines with a word, compared by their lower-cased words. A null or empty text has
    no words and fails; a null host is the host ''. Repeated rows and equal texts of a host count once towards a line.
    Lines and texts are told apart by 64-bit hashes: of n different ones, two are one with odds of about n * n / 2^65.
    """
    prof = profiles(docs)
    return verdicts(prof, frequent_lines(prof, line_docs, line_share))


def clean_documents(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Rows that pass, with the columns of docs; lines above the limits are taken out of `text` (and n_chars follows).

    Rows are matched to verdicts by host and exact text, so null or repeated doc_ids do no harm.
    """
    cols = docs.columns
    key, bad, gone = (fresh(c, cols) for c in ("key", "bad_lines", "gone"))
    tagged = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    narrow = tagged.select(F.col(key).alias("doc_id"), F.col("source"), F.col("text"))
    prof = profiles(narrow)
    frequent = frequent_lines(prof, line_docs, line_share)
    v = verdicts(prof, frequent)
    rejected = materialize(v.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "rejected")
    out = tagged.join(rejected, F.col(key) == F.col(gone), "left_anti")
    marked = prof.select("doc_id", "host", F.explode("line_hashes").alias("line_hash")).join(frequent, ["host", "line_hash"]).groupBy("doc_id").agg(F.collect_set("line_hash").alias(bad))
    marked = materialize(marked.join(v.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias(gone), bad), "marked")
    out = out.join(marked, F.col(key) == F.col(gone), "left").select(*(F.col(f"`{c}`") for c in cols), bad)
    out = out.mapInArrow(_strip, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out


def op6_line_frequency(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


_W = r"[^\x20\x09-\x0D]+"
ORACLES = {"op6_line_frequency": rf"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select doc_id, host, t, regexp_extract_all(t, '{_W}') ws from d),
ln as (select doc_id, host, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from w),
lw as (select doc_id, host, l, i, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') lws from ln),
ll as (select *, array_to_string(lws, ' ') norm, len(lws) k from lw where len(lws) > 0),
tx as (select doc_id, host, array_to_string(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), ' ') tt from d),
hosts as (select host, count(distinct tt) hd from tx group by host),
fr as (select ll.host, norm from ll join tx using (doc_id, host) group by all having count(distinct tt) > {LINE_DOCS}),
frq as (select ll.host, ll.norm, count(distinct tt) n from ll join fr using (host, norm) join tx using (doc_id, host) group by all),
bad as (select host, norm from frq join hosts using (host) where n > hd * {LINE_SHARE}),
lost as (select doc_id, sum(k) s from ll join bad using (host, norm) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) n from ll group by doc_id),
pos as (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from w where len(ws) >= 5),
win as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) c from pos),
rep as (select doc_id, count(distinct i + o) n from win, (select unnest(range(5)) o) where c > 1 group by doc_id),
base as (select doc_id, len(ws) n_words, coalesce(length(array_to_string(ws, '')), 0) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols from w),
f as (select b.doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(coalesce(dup.n, 0) as bigint) n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) n_repeat_words, cast(coalesce(lost.s, 0) as bigint) n_line_words from base b left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
g as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 20 * n_words base_failed from f)
select *, not base_failed and n_words - n_line_words >= {MIN_WORDS} and n_words - n_line_words >= n_words * {LEFT_SHARE} kept from g"""}
QUERIES = {"op6_line_frequency": op6_line_frequency}
