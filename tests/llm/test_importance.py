"""Importance resampling: features, gains, weights and draws by plain loops, and odd inputs."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from panelwright.llm import importance
from panelwright.llm.words import text_buffers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})
LONG = "x" * 70


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def buckets(t):
    w = words(t)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        rows.append([i, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    full = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(full[: 5 * len(full) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(spark, docs, target):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, bucket int, score int")
    rows = importance.resample(d, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=repr)


def test_resampling_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"W{k}" for k in rng.zipf(1.3, rng.integers(0, 120)) % 500)) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,;\n "), (1003, "Ünï cödé ÉÉ-99_a"), (1004, f"a {LONG} b {LONG}{LONG}"), (1005, "one\ntwo\n\n three"), (1006, "word " * 30000), (None, "null " * 25), docs[7], docs[7]]
    target = ["w1 w2 w3 w4", None, "", "w1 w1 w9"]
    assert got(spark, docs, target) == brute(docs, target)


def test_a_third_of_all_rows_equal_and_ties(spark):
    docs = [(i // 2, "equal words " * 15 if i % 3 else f"other words {i} " * 9) for i in range(240)]
    assert [x[:4] for x in got(spark, docs, ["equal words"])] == [x[:4] for x in brute(docs, ["equal words"])]
    assert sorted(x[4] for x in got(spark, docs, ["equal words"]) if x[4]) == list(range(1, 13))


def test_no_rows(spark):
    assert got(spark, [], ["a"]) == []
    assert got(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_scan_spans_stay_in_their_documents():
    texts = ["A b", "", "c", None, "d e f g", "--", f"h {LONG} i"]
    n_words, n, got = importance.scan(*text_buffers(pa.array(texts)))
    assert n_words.tolist() == [len(words(t)) for t in texts] and n.tolist() == [len(buckets(t)) for t in texts]
    ends = np.cumsum(n)
    assert [sorted(got[b - k : b].tolist()) for k, b in zip(n, ends)] == [sorted(buckets(t)) for t in texts]
