"""BM25 retrieval and verified leaks against a plain BM25 over all items and passages."""
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import decontaminate as D
from panelwright.llm import words


def corpus(seed, n_items, n_docs):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401) ** 0.8
    weights /= weights.sum()
    text = lambda n: list(rng.choice(vocabulary, n, p=weights))
    items = [" ".join(text(int(rng.integers(4, 40))) + (["end?"] + text(3) if i % 3 == 0 else [])) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        t = text(int(rng.integers(0, 300)))
        if i % 2:
            leak = items[int(rng.integers(n_items))].split()
            for k in rng.integers(0, len(leak), i % 5):
                leak[k] = "edited"
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = leak
        docs.append(" ".join(t))
    return items, docs


def plain_bm25(items, docs):
    """{(document, item): (score, overlaps)} by scoring every item for every passage."""
    bags = [Counter(D.bare(t)) for t in items]
    n = sum(bool(b) for b in bags)
    df = Counter(w for b in bags for w in b)
    mean = sum(b.total() for b in bags) / n
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    part = lambda b, w: idf[w] * b[w] * (D.K1 + 1) / (b[w] + D.K1 * (1 - D.B + D.B * b.total() / mean))
    own = [sum(part(b, w) for w in b) * D.RETRIEVE for b in bags]
    size = max(64, 2 * max(b.total() for b in bags))
    halves = D.Index(list(range(len(items))), items)
    parts = dict(zip(halves.ids, halves.parts))
    out = {}
    for d, t in enumerate(docs):
        w = D.bare(t)
        for a in range(0, max(1, -(-(len(w) - size // 2) // (size // 2))) * (size // 2), size // 2):
            passage = w[a : a + size]
            for i, b in enumerate(bags):
                score = sum(part(b, x) for x in set(passage) & b.keys()) / own[i] if own[i] else 0
                if score >= D.REACHED:
                    q, z = (D._overlap(p, passage) for p in parts[i])
                    if q >= D.QUESTION and z >= D.ANSWER:
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, q, z))
    return out


@pytest.mark.parametrize("index_words", [10**7, 4000])
def test_found_pairs_are_those_of_a_plain_scan(spark, index_words, monkeypatch):
    monkeypatch.setattr(D, "INDEX_WORDS", index_words)  # the second: several parts, the same scores
    items, docs = corpus(1, 700, 60)
    want = plain_bm25(items, docs)
    assert len(want) > 25
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in D.contaminated(d, b).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_retrieval_is_exact_whatever_the_threshold(monkeypatch):
    items, docs = corpus(2, 150, 30)
    for share in (0.2, 0.45, 0.8):
        monkeypatch.setattr(D, "RETRIEVE", share)
        index = D.Index(list(range(len(items))), items)
        w = words.split(*words.text_buffers(pa.array(docs)), lower=True)
        at, hit = index.look_up(w.hash)
        key = np.unique(w.doc[hit] * np.int64(len(index.words)) + at[hit])
        p, item, score = D.retrieve(index, key // len(index.words), key % len(index.words))
        dense = np.zeros((len(docs), len(items)))
        term = index.block_key // index.blocks
        for e in range(len(term)):
            for q in range(index.block_start[e], index.block_end[e]):
                for d in (key // len(index.words))[key % len(index.words) == term[e]]:
                    dense[d, index.item[q]] += index.score[q]
        want = {(d, i): dense[d, i] for d, i in zip(*np.nonzero(dense >= D.REACHED))}
        got = dict(zip(zip(p.tolist(), item.tolist()), score.tolist()))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_odd_items_and_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    b = spark.createDataFrame([(None, item), (2, item), (3, ""), (4, None), (5, "...")], "item_id long, text string")
    d = spark.createDataFrame([(1, item.upper()), (None, f"x {item}, y"), (2, ""), (3, None), (1, item.upper()), (4, "alpha beta " * 20000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()), key=repr)
    assert got == sorted([(1, None), (1, 2), (None, None), (None, 2), (1, None), (1, 2)], key=repr)
    assert D.contaminated(d, b.limit(0)).count() == D.contaminated(d.limit(0), b).count() == 0
    wide = d.selectExpr("doc_id", "text", "1 key", "2 bad_key", "3 `KEY2`")
    kept = D.drop_contaminated(wide, b)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
