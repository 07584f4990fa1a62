"""Benchmark passages in documents: a BM25 inverted index with block-max WAND, then question and answer overlap."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize, read_table
from .words import CHUNK_BYTES, runs, signed, split

#: Words of test items in one broadcast index (some 100 MB with their texts), and items in a block whose largest scores are kept.
INDEX_WORDS, BLOCK_ITEMS = 4_000_000, 8
K1, B = 1.2, 0.75
#: An item is retrieved for a passage from this share of its own score on; part of its question that must overlap, and of its answer.
RETRIEVE, QUESTION, ANSWER = 0.6, 0.6, 0.6
#: A relative score that retrieves, less the rounding of single precision.
REACHED = 1 - 1e-4
#: Words of the passages that are searched at once.
BATCH_WORDS = 400_000
EDGE = re.compile(r"^[!-/:-@\[-^`{-~]+|[!-/:-@\[-^`{-~]+$")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
_ASCII = {x: x + 32 for x in range(65, 91)}
_MARK = np.array([33 <= x < 127 and not chr(x).isalnum() and x != 95 for x in range(256)])
_BLANK = np.array([x == 32 or 9 <= x <= 13 for x in range(256)])


def _ragged(start, size):
    """start[i], start[i] + 1, ... (size[i] of them) for each i, one after the other; and i for each."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(owner)), owner


class Index:
    """Postings of each word over items in order of length, in blocks of BLOCK_ITEMS.

    A posting holds the word's BM25 contribution relative to the score that retrieves the item, so one threshold, 1,
    serves items of any length. `bound` has a word's largest contribution and `block_max` that to each block it is in.
    """

    def __init__(self, ids: list, texts: list[str], df=None, n_items: int | None = None, mean_length: float | None = None, longest: int | None = None):
        """df: number of items of the whole test set with a word, by its hash; n_items, mean_length and longest of the whole set."""
        w = _bare_words(*_buffers(texts))
        n = np.diff(w.first)
        keep = np.flatnonzero(n > 0)
        order = keep[np.argsort(n[keep], kind="stable")]  # items of like length share blocks, which tightens their bounds
        rank = np.full(len(n), -1)
        rank[order] = np.arange(len(order))
        self.ids, self.length = [ids[i] for i in order.tolist()], n[order]
        self.words, term = np.unique(w.hash, return_inverse=True)
        self.blocks = -(-max(len(order), 1) // BLOCK_ITEMS)
        key, tf = np.unique(term * np.int64(len(order) + 1) + rank[w.doc], return_counts=True)
        term, self.item = key // (len(order) + 1), key % (len(order) + 1)
        own_df = np.bincount(term, minlength=len(self.words))
        self.df = own_df if df is None else np.array([df.get(int(h), 1) for h in signed(self.words)])
        count, mean = n_items or len(order), mean_length or (self.length.mean() if len(order) else 1)
        idf = np.log(1 + (count - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * self.length / max(mean, 1))
        score = idf[term] * tf * (K1 + 1) / (tf + norm[self.item])
        own = np.bincount(self.item, weights=score, minlength=len(order))
        score = score / np.maximum(own[self.item] * RETRIEVE, 1e-12)
        # words are numbered by their bound, so that the words of a passage come in the order that the search needs
        bound = np.zeros(len(self.words))
        np.maximum.at(bound, term, score)
        by_bound = np.argsort(bound, kind="stable")
        self.bound, self.number = bound[by_bound], np.empty(len(by_bound), np.int64)
        self.number[by_bound] = np.arange(len(by_bound))
        term = self.number[term]
        at = np.lexsort((self.item, term))
        term, self.item, self.score = term[at], self.item[at], score[at]
        # one entry for each word and block: the range of its postings and their largest score
        self.block_key, first = np.unique(term * np.int64(self.blocks) + self.item // BLOCK_ITEMS, return_index=True)
        self.block_end = np.append(first[1:], len(self.score))
        self.block_start = first
        self.block_max = np.maximum.reduceat(self.score, first) if len(first) else np.zeros(0)
        self.ptr = np.searchsorted(self.block_key, np.arange(len(self.words) + 1) * self.blocks)
        self.passage = max(64, 2 * (longest or int(self.length.max()))) if len(order) else 64
        self.parts = []
        for d in order.tolist():
            text = texts[d]
            cut = max(text.rfind("?"), text.find("\n") if "?" not in text else -1)
            # without a real question mark or break the item is one part
            parts = (text[: cut + 1], text[cut + 1 :]) if text[: cut + 1].strip() and text[cut + 1 :].strip() else (text, "")
            self.parts.append(tuple(bare(x) for x in parts))

    def look_up(self, h):
        """The number of each word, and whether there is one."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return self.number[at], self.words[at] == h

    def entries(self, term, block):
        """The entry of each (word, block), and whether there is one."""
        key = term * np.int64(self.blocks) + block
        at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        return at, self.block_key[at] == key


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray):
    """(passage, item, score) of all items that reach 1, for ascending distinct (passage, term) rows.

    Block-max WAND over a batch: a passage's words stand in the order of their bound. Those whose bounds together stay below 1
    cannot retrieve anything alone, so the word after them is the pivot: only blocks with a posting of it or of a later
    word are opened. A block is skipped where its maxima, with the bounds of the words before the pivot, and then with
    their maxima in the block, stay below 1. Postings are read in the blocks that are left alone.
    """
    bound = index.bound[term]
    first = np.searchsorted(passage, np.arange(passage[-1] + 2)) if len(passage) else np.zeros(1, np.int64)
    total = np.concatenate([[0.0], np.cumsum(bound)])
    before = total[1:] - total[first[passage]] < REACHED  # words before the pivot
    n_before = np.bincount(passage[before], minlength=len(first) - 1)
    rest = total[first[:-1] + n_before] - total[first[:-1]]
    lead = np.flatnonzero(~before)
    entry, owner = _ragged(index.ptr[term[lead]], index.ptr[term[lead] + 1] - index.ptr[term[lead]])
    if not len(entry):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    key, place = np.unique(passage[lead][owner] * np.int64(index.blocks) + index.block_key[entry] % index.blocks, return_inverse=True)
    upper = np.bincount(place, weights=index.block_max[entry], minlength=len(key))
    p, block = key // index.blocks, key % index.blocks
    open_ = upper + rest[p] >= REACHED
    p, block, upper = p[open_], block[open_], upper[open_]
    row, owner = _ragged(first[p], n_before[p])
    at, hit = index.entries(term[row], block[owner])
    upper = upper + np.bincount(owner[hit], weights=index.block_max[at[hit]], minlength=len(p))
    open_ = upper >= REACHED
    p, block = p[open_], block[open_]
    row, owner = _ragged(first[p], first[p + 1] - first[p])
    at, hit = index.entries(term[row], block[owner])
    at, owner = at[hit], owner[hit]
    posting, which = _ragged(index.block_start[at], index.block_end[at] - index.block_start[at])
    score = np.bincount(owner[which] * BLOCK_ITEMS + index.item[posting] % BLOCK_ITEMS, weights=index.score[posting], minlength=len(p) * BLOCK_ITEMS)
    found = np.flatnonzero(score >= REACHED)
    return p[found // BLOCK_ITEMS], block[found // BLOCK_ITEMS] * BLOCK_ITEMS + found % BLOCK_ITEMS, score[found]


def _buffers(texts):
    data = [(t or "").encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), np.frombuffer(b"".join(data), np.uint8)


def _bare_words(offsets, data):
    """Lower-cased words, with the ASCII punctuation at their ends taken for space."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    mark, blank = np.zeros(len(data) + 2, bool), np.ones(len(data) + 2, bool)
    mark[1:-1], blank[1:-1] = _MARK[data], _BLANK[data]
    start = np.flatnonzero(mark[1:-1] & (~mark[:-2] | cut[:-1]))
    end = np.flatnonzero(mark[1:-1] & (~mark[2:] | cut[1:])) + 1
    edge = blank[start] | cut[start] | blank[end + 1] | cut[end]
    steps = np.bincount(start[edge], minlength=len(data) + 1) - np.bincount(end[edge], minlength=len(data) + 1)
    return split(offsets, np.where(np.cumsum(steps[:-1]) > 0, np.uint8(32), data), lower=True)


def bare(text: str) -> list[str]:
    """Words with A-Z in lower case, without the ASCII punctuation at their ends; words of punctuation alone are left out."""
    return [x for x in (EDGE.sub("", x) for x in BLANK.split(text.translate(_ASCII))) if x]


def _overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's words that stand in the passage in the same order (longest common subsequence)."""
    if not part:
        return 1.0
    where: dict[str, int] = {}
    for i, x in enumerate(part):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(part)) - 1, (1 << len(part)) - 1
    for x in passage:
        m = row & where.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return 1 - row.bit_count() / len(part)


def passages(words, size: int):
    """(document, first word, end) of the windows of `size` words, half overlapping, of each document with words."""
    stride = size // 2
    length = np.diff(words.first)
    count = np.where(length > 0, np.maximum(1, -(-(length - stride) // stride)), 0)
    doc = np.repeat(np.arange(len(length)), count)
    start = words.first[doc] + (np.arange(len(doc)) - np.searchsorted(doc, doc)) * stride
    return doc, start, np.minimum(start + size, words.first[doc + 1])


def search(index: Index, words):
    """(document, item): (relative score, question overlap, answer overlap) of each verified pair; its best passage."""
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(words.doc) or not len(index.words) or not len(index.ids):
        return found
    at, hit = index.look_up(words.hash)
    doc, start, end = passages(words, index.passage)
    step = max(1, BATCH_WORDS // index.passage)
    for i in range(0, len(doc), step):
        a, b = start[i : i + step], end[i : i + step]
        place, owner = _ragged(a, b - a)
        keep = hit[place]
        key = np.unique(owner[keep] * np.int64(len(index.words)) + at[place[keep]])
        texts: dict[int, list[str]] = {}
        for p, item, score in zip(*(x.tolist() for x in retrieve(index, key // len(index.words), key % len(index.words)))):
            if p not in texts:
                texts[p] = bare(words.data[words.start[a[p]] : words.end[b[p] - 1]].tobytes().decode(errors="replace"))
            oq, oa = (_overlap(part, texts[p]) for part in index.parts[item])
            if oq >= QUESTION and oa >= ANSWER:
                pair = (int(doc[i + p]), item)
                found[pair] = max(found.get(pair, (0.0, 0.0, 0.0)), (score, oq, oa))
    return found


def _search_rows(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for rows, offsets, data in runs(batch, limit=CHUNK_BYTES):
                found = search(index, _bare_words(offsets, data))
                d = np.array([k[0] for k in found], np.int64)
                ids = rows.column(0).take(pa.array(d))
                keys = rows.column(2).take(pa.array(d))
                v = list(found.values())
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array([index.ids[k[1]] for k in found], pa.int64()), *(pa.array([x[j] for x in v], pa.float64()) for j in range(3))], names=["doc_id", "key", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _item_words(batches):
    """(hash) of each distinct word of each item, and a row (null, length) of the item."""
    for batch in batches:
        for rows, offsets, data in runs(batch):
            w = _bare_words(offsets, data)
            key = np.unique(np.stack([w.doc.astype(np.uint64), w.hash], 1), axis=0)[:, 1] if len(w.doc) else np.zeros(0, np.uint64)
            n = np.diff(w.first)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(signed(np.ascontiguousarray(key))), pa.nulls(len(n), pa.int64())]), pa.concat_arrays([pa.nulls(len(key), pa.int64()), pa.array(n)])], names=["h", "length"])


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, score, question_overlap, answer_overlap): a row for each document and test item in it.

    Every passage of every text (windows of twice the longest item, half overlapping) is a query. score is relative to
    the item's score for itself times RETRIEVE; document frequencies and the mean length are those of the whole test
    set. A test set of more than INDEX_WORDS words is searched in parts, each with a broadcast index of its own; scores
    stay the same. Null or empty texts and items match nothing; items with a null id count and match under it; repeated
    rows each match; of equal items each has its row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    counts = materialize(items.select("text").mapInArrow(_item_words, "h long, length long"), "item_words")
    sums = counts.agg(F.count(F.when(F.col("length") > 0, 1)).alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
    schema = "doc_id long, key long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    if not sums.n:
        return out
    frequency = materialize(counts.filter("h is not null").groupBy("h").agg(F.count("*").alias("df")), "item_frequency")
    parts = max(1, -(-sums.words // INDEX_WORDS))
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        own = part.select("text").mapInArrow(_item_words, "h long, length long").select("h").distinct()
        df = frequency.join(own, "h", "left_semi") if parts > 1 else frequency
        df = df.toArrow()
        texts = part.orderBy("item_id", "text").toArrow().to_pylist()
        if texts:
            df = dict(zip(df.column("h").to_pylist(), df.column("df").to_pylist()))
            shared = spark.sparkContext.broadcast(Index([r["item_id"] for r in texts], [r["text"] for r in texts], df, sums.n, sums.words / sums.n, sums.longest))
            found = rows.mapInArrow(_search_rows(shared), schema)
            out = found if parts == 1 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a test item, with the columns of docs. Rows are told apart by their text, so null doc_ids do no harm."""
    key, bad_key = fresh("key", docs.columns), fresh("bad_key", docs.columns)
    bad = materialize(contaminated(docs, benchmark).select(F.col("key").alias(bad_key)).distinct(), "contaminated")
    tagged = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return tagged.join(bad, F.col(key) == F.col(bad_key), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_bm25_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


QUERIES = {"op10_bm25_decontamination": op10_bm25_decontamination}
ORACLES: dict = {}
