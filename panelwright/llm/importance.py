"""Importance resampling towards a target: an overlapped regex scan of n-grams, CRC buckets, and a draw by Gumbel keys."""
from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, read_table
from .words import runs

BUCKETS, GRAM = 10_000, 3
MIN_WORDS, PER_CENT, SEED = 20, 5, 42
#: Up to this length bytes of words go through the CRC side by side; longer words one by one.
SIDE_BY_SIDE = 48
#: Bytes to words and spaces: A-Z in lower case; digits, letters and all beyond ASCII stay, the rest separates.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = regex.compile(rb" +")
#: A separator, then up to GRAM words that end at a boundary. With overlapping matches each word starts one.
_GRAMS = regex.compile(rb" [^ \n]++(?: [^ \n]++){0,%d}+(?![^ \n])" % (GRAM - 1))
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what `state` stands for, followed by data[start:end] of each row."""
    out, size = state ^ np.uint32(0xFFFFFFFF), end - start
    rows = np.flatnonzero((size > 0) & (size <= SIDE_BY_SIDE))
    k = 0
    while len(rows):
        s = out[rows]
        out[rows] = _CRC[(s ^ data[start[rows] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
        rows = rows[size[rows] > k]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def scan(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the number of its words and of its features, and the buckets of all features in turn.

    Documents become lines of words between single spaces. The regex finds, overlapping, the span from each word to the
    end of its longest n-gram; the shorter ones end where the next words start.
    """
    raw, o = data.tobytes().translate(_CLEAN), offsets.tolist()
    lines = [b" " + _SPACES.sub(b" ", raw[a:b]).strip() for a, b in zip(o, o[1:])]
    body = b"\n".join(lines)
    span = np.fromiter(chain.from_iterable(m.span() for m in _GRAMS.finditer(body, overlapped=True)), np.int64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).astype(np.int64)  # of each line, with one more
    doc = np.searchsorted(first, span[:, 0], "right") - 1
    n_words = np.bincount(doc, minlength=len(lines))
    byte, n = np.frombuffer(body, np.uint8), len(span)
    bound = np.append(span[:, 0], len(body))
    state, out = np.zeros(n, np.uint32), []
    for k in range(GRAM):  # the k-th word after each start, while it is of the same document
        i = np.flatnonzero(doc[: n - k] == doc[k:]) if k < n else np.zeros(0, np.int64)
        last = np.append(doc[1:] != doc[:-1], True)[i + k] if n else np.zeros(0, bool)
        end = np.where(last, span[i + k, 1], bound[i + k + 1])
        state[i] = _crc_on(state[i], byte, span[i + k, 0] + (k == 0), end)
        out.append((doc[i], state[i] % np.uint32(BUCKETS)))
    docs, buckets = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(docs, kind="stable")
    return n_words, np.bincount(docs, minlength=len(lines)), buckets[order].astype(np.uint16)


def _feature_rows(batches):
    for batch in batches:
        for rows, offsets, data in runs(batch):
            n_words, n, buckets = scan(offsets, data)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]) * 2, pa.int32())
            body = pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(buckets.tobytes())])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), body], names=["doc_id", "n_words", "n_features", "buckets"])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row; buckets holds two bytes a feature."""
    key = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(key.alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_feature_rows, "doc_id long, n_words long, n_features long, buckets binary")


def _buckets(batch: pa.RecordBatch, name: str = "buckets") -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows in turn, and where each row starts (with one more entry)."""
    col = batch.column(batch.schema.get_field_index(name))
    values = [np.frombuffer(x.as_buffer(), np.uint16) for x in col]
    return (np.concatenate(values) if values else np.zeros(0, np.uint16)), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def _count_rows(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_buckets(batch)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(feats: DataFrame) -> DataFrame:
    """(bucket, n): each task counts its rows before anything moves, so no text or bucket is hot."""
    return feats.select("buckets").mapInArrow(_count_rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all BUCKETS buckets, from the bucket counts of the documents and of the target."""
    spark = docs.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(docs.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))
    ratio = f"((t + 1D) * (ss + {BUCKETS}D)) / ((s + 1D) * (tt + {BUCKETS}D))"
    return both.join(F.broadcast(total)).select("bucket", F.expr(f"cast(floor(1000 * ln({ratio})) as long)").alias("gain"))  # one row of totals


def _weight_rows(table: np.ndarray):
    def run(batches):
        for batch in batches:
            b, first = _buckets(batch)
            sums = np.concatenate([[0], np.cumsum(table[b])])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sums[first[1:]] - sums[first[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(feats: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of each row's features. The gains are BUCKETS numbers."""
    rows = gain.orderBy("bucket").collect()
    table = np.array([r.gain for r in rows], np.int64)
    return feats.mapInArrow(_weight_rows(table), "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: str = "doc_id", seed: int = SEED) -> str:
    """SQL of floor(-1000 * ln(-ln(u))), u from the first 32 bits of SHA-256 of `seed:key` (a null key is the text '')."""
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast({key} as string), '')), 256), 1, 8), 16, 10) as long)"
    return f"cast(floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D))) as long)"


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS, text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for the rows that are not drawn.

    Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII; features are all runs of one to
    three words. Of the rows with at least min_words words, per_cent of a hundred are drawn (rounded down), those of the
    highest weight + Gumbel number; ties go to the smaller doc_id, a null one first, and rows equal in both follow one
    another. Null and empty texts have no features and weight 0; an empty table gives none. Other columns are not read.

    Texts are scanned once. Ranks come from one sort over ranges of (score, doc_id) and the row counts of its partitions.
    """
    feats = materialize(features(docs, text), "features")
    gain = gains(bucket_counts(feats), bucket_counts(features(target, target_text)))
    rows = weights(feats, gain).withColumn("score", F.col("weight") + F.expr(gumbel())).withColumn("short", F.col("n_words") < min_words)
    order = ["short", F.desc("score"), F.asc("doc_id")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.select("doc_id", "n_features", "weight", "score", "short", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(~F.col("short"), 1)).alias("long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    everyone = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("long").over(everyone).alias("long"))
    sizes = sizes.select("part", "offset", F.expr(f"long * {int(per_cent)} div 100").alias("draw"))
    rank = F.col("offset") + F.col("at") + 1
    return placed.join(F.broadcast(sizes), "part").select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (rank <= F.col("draw")), rank).alias("rank"))


def op13_overlapped_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents towards all benchmark texts; null texts have no features."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(f"select r, array_to_string(ws[i:i + {k - 1}], ' ') f from (select r, ws, unnest(range(1, len(ws) - {k - 2})) i from {{0}} where len(ws) >= {k})" for k in range(1, GRAM + 1))
    return rf"""
with crc as (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc_table
  from (select unnest(range(256)) i order by i)),
d as (select row_number() over () r, doc_id, regexp_extract_all({lower}, '{word}') ws from documents),
b as (select row_number() over () r, regexp_extract_all({lower}, '{word}') ws from benchmark),
df as materialized (select r, f, count(*) k from ({grams.format("d")}) group by all),
bf as (select f, count(*) k from ({grams.format("b")}) group by all),
code as materialized (select f, xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint),
  lambda c, x: xor(crc_table[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) % {BUCKETS} bucket from (select f from df union select f from bf), crc),
s as (select bucket, sum(k) s from df join code using (f) group by bucket),
t as (select bucket, sum(k) t from bf join code using (f) group by bucket),
g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {BUCKETS})::double)
  / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + {BUCKETS})::double)))::bigint gain
  from (select unnest(range({BUCKETS})) bucket) left join s using (bucket) left join t using (bucket)),
w as (select r, sum(k * gain) weight, sum(k) n from df join code using (f) join g using (bucket) group by r),
x as (select doc_id, len(ws) nw, coalesce(n, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint e from d left join w using (r)),
y as (select *, weight + e score, row_number() over (partition by nw >= {MIN_WORDS} order by weight + e desc, doc_id) place, count(*) filter (where nw >= {MIN_WORDS}) over () n from x)
select doc_id, n_features, weight, score, case when nw >= {MIN_WORDS} and place <= n * {PER_CENT} // 100 then place end as rank from y"""


ORACLES = {"op13_overlapped_resampling": _oracle()}
QUERIES = {"op13_overlapped_resampling": op13_overlapped_resampling}
