"""Difference-cover anchors: find word sequences that a document shares with an earlier one, and remove them."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitset import BitSet
from .store import materialize, read_table
from .words import runs, signed, split, window_hashes

#: Words of the shortest match.
MATCH = 50
#: A perfect difference cover: every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words of an anchor: any match of MATCH words holds, at one of PERIOD alignments, an anchor that both sides hash.
ANCHOR = MATCH - PERIOD + 1


def _anchors(words):
    """(index of the first word, hash) of each anchor."""
    n = len(words.doc)
    if n < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    at = np.arange(n - ANCHOR + 1)
    size = words.first[words.doc + 1] - words.first[words.doc]
    ok = cover[words.pos()[at] % PERIOD] & (words.doc[at] == words.doc[at + ANCHOR - 1]) & (size[at] >= MATCH)
    return at[ok], window_hashes(words.hash, ANCHOR)[ok]


def _anchor_rows(batches):
    for batch in batches:
        for rows, offsets, data in runs(batch):
            w = split(offsets, data)
            at, h = _anchors(w)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ids[w.doc[at]])], names=["h", "doc_id"])


def _spans(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) for one of the starts."""
    edges = np.zeros(n + width + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges)[:n] > 0


def _window_rows(met: BitSet):
    """Windows around matched anchors. One that a document with a smaller doc_id of the same run of rows has is sure to
    go; so a window that a third of all documents hold has one open row for each run, whatever their number."""

    def run(batches):
        for batch in batches:
            for rows, offsets, data in runs(batch):
                w = split(offsets, data)
                at, h = _anchors(w)
                at = at[met.may_hold(h)]
                if not len(at):
                    continue
                # windows that hold an anchor start at most PERIOD - 1 words before it
                lo = np.maximum(at - PERIOD + 1, 0)
                cand = np.flatnonzero(_spans(lo, PERIOD, len(w.doc)))
                cand = cand[cand + MATCH <= len(w.doc)]
                cand = cand[w.doc[cand] == w.doc[cand + MATCH - 1]]
                ids, keys = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                d = w.doc[cand]
                wide, own = window_hashes(w.hash, MATCH)[cand], ids[d]
                order = np.lexsort((own, wide))
                new = np.append(True, wide[order][1:] != wide[order][:-1]) if len(order) else np.zeros(0, bool)
                sure = np.zeros(len(order), bool)
                sure[order] = own[order] > own[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(wide)), pa.array(own), pa.array(keys[d]), pa.array((cand - w.first[d]).astype(np.int32)), pa.array(sure)], names=["h", "doc_id", "key", "start", "sure"])

    return run


def _whole_rows(losing: BitSet, with_text):
    """Digest of each whole document; its text goes on only where the filter says that it may lose words."""

    def run(batches):
        for batch in batches:
            for rows, offsets, data in runs(batch):
                w = split(offsets, data)
                raw = data.tobytes()
                keys = rows.column(2).to_numpy(zero_copy_only=False)
                may = losing.may_hold(keys.view(np.uint64)) | with_text
                s, e = w.start.tolist(), w.end.tolist()
                f = w.first.tolist()
                sha = [hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s[a:b], e[a:b])])).hexdigest() for a, b in zip(f, f[1:])]
                text = pa.array([raw[x:y].decode() if m else None for x, y, m in zip(offsets.tolist(), offsets[1:].tolist(), may.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(w.first)), pa.array(sha, pa.string()), text], names=["doc_id", "key", "n_words", "sha", "text"])

    return run


def _removal_rows(batches):
    """Apply the removed starts of each row (null: none) to its words."""
    for batch in batches:
        names = batch.schema.names
        lists, base = batch.column(names.index("starts")), 0
        for rows, offsets, data in runs(batch):
            w = split(offsets, data)
            raw = data.tobytes()
            sha, text = rows.column(names.index("sha")).to_pylist(), rows.column(names.index("text")).to_pylist()
            gone = [0] * rows.num_rows
            for i in range(rows.num_rows):
                starts = lists[base + i].values
                a, b = w.first[i], w.first[i + 1]
                keep = slice(None)
                if starts is not None and len(starts):
                    hit = _spans(starts.to_numpy(zero_copy_only=False).astype(np.int64), MATCH, b - a)
                    gone[i], keep = int(hit.sum()), np.flatnonzero(~hit)
                if text[i] is not None:
                    kept = b" ".join([raw[x:y] for x, y in zip(w.start[a:b][keep].tolist(), w.end[a:b][keep].tolist())])
                    sha[i], text[i] = hashlib.sha256(kept).hexdigest(), kept.decode()
            base += rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(names.index("doc_id")), rows.column(names.index("n_words")), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def shared_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, starts): for each row of docs(doc_id, text, key), the word positions of its windows of MATCH words
    that also start in a document with a smaller doc_id. Rows without such a window are absent."""
    anchors = docs.select("doc_id", "text").mapInArrow(_anchor_rows, "h long, doc_id long")
    # a hot anchor is reduced to one row on each map task before it moves
    met = materialize(anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h"), "anchors")
    windows = docs.select("doc_id", "text", "key").mapInArrow(_window_rows(BitSet(met, "h")), "h long, doc_id long, key long, start int, sure boolean")
    # sure windows need no meeting: they are dealt out by themselves
    dealt = windows.withColumn("at", F.when(F.col("sure"), F.xxhash64("key", "start")).otherwise(F.col("h")))
    low = F.min(F.when(~F.col("sure"), F.col("doc_id"))).over(Window.partitionBy("at"))
    lost = dealt.withColumn("low", low).filter(F.col("sure") | (F.col("doc_id") > F.col("low")))
    return lost.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))


def remove_shared(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every row of docs.

    A window is MATCH consecutive words of one document; each word in a window whose words also start in a document with
    a smaller doc_id goes. Windows are judged on the input. Rows with one doc_id are one document to this test; a null
    doc_id is neither smaller nor larger than any. A null or empty text has no words; an empty table gives none. Windows
    are told apart by 64-bit hashes: of n different ones, two are taken for one with odds of about n * n / 2^65.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = materialize(shared_windows(rows.filter("doc_id is not null")), "removed")
    # one pass digests every text; those that may lose words move to their starts, the others stay behind
    whole = rows.mapInArrow(_whole_rows(BitSet(found, "key"), with_text), "doc_id long, key long, n_words long, sha string, text string")
    out = whole.join(found, ["doc_id", "key"], "left").select("doc_id", "n_words", "sha", "text", "starts")
    out = out.mapInArrow(_removal_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def op7_difference_cover(spark, sf_dir: str) -> DataFrame:
    return remove_shared(read_table(spark, sf_dir, "documents"), with_text=False)


_W = r"[^\x20\x09-\x0D]+"
ORACLES = {"op7_difference_cover": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - {MATCH} + 2)) i from w where len(ws) >= {MATCH}),
win as (select doc_id, i, md5(array_to_string(ws[i:i + {MATCH - 1}], ' ')) h from p),
hit as (select doc_id, i from (select *, min(doc_id) over (partition by h) low from win) where doc_id > low),
gone as (select distinct doc_id, i + o j from hit, (select unnest(range({MATCH})) o)),
pos as (select doc_id, ws, unnest(range(1, len(ws) + 1)) j from w),
kept as (select p.doc_id, string_agg(ws[j], ' ' order by j) t from pos p anti join gone g using (doc_id, j) group by p.doc_id),
ng as (select doc_id, count(*) n from gone group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept using (doc_id) left join ng using (doc_id)"""}
QUERIES = {"op7_difference_cover": op7_difference_cover}
