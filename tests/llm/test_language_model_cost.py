"""What the language model works on at once, and the rows that counting sends on: both set its CPU seconds."""
import tracemalloc

import numpy as np
import pyarrow as pa

from panelwright.llm import language_model as lm
from panelwright.llm import words


def cut(texts):
    return words.split(*words.text_buffers(pa.array(texts)), lower=True)


def plain_scores(net, table, w, n_docs):
    """Scores of documents with the same number of words: rows of states, row by row softmax, a sorted look-up."""
    key = w.hash & ~np.uint64(lm.LANGS - 1)
    at = np.minimum(np.searchsorted(table.hashes, key), len(table.hashes) - 1)
    known = table.hashes[at] == key
    pick = lambda a, other: np.where(known, a[at], other).astype(np.int64).reshape(n_docs, -1)
    end = np.full((n_docs, 1), table.end)
    ids = np.hstack([end + lm.FREQUENT, pick(table.input_id, lm.FREQUENT + table.rare)])
    cls, place = np.hstack([pick(table.cls, table.rare), end]), np.hstack([pick(table.place, -1), end * 0 - 1])
    p, m, h = net.p, lm.HIDDEN, np.zeros((n_docs, lm.HIDDEN), np.float32)
    total = np.where(known, table.share[at], 0).reshape(n_docs, -1).sum(axis=1, dtype=float)
    for t in range(ids.shape[1]):
        a, g = p["x"][ids[:, t]], h @ p["u"]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * m] + g[:, : 2 * m])))
        n = np.tanh(a[:, 2 * m :] + zr[:, m:] * g[:, 2 * m :])
        h = n + zr[:, :m] * (h - n)
        logits = h @ p["v"] + p["b"] + net.mask
        logits -= logits.max(axis=1, keepdims=True)
        total += logits[np.arange(n_docs), cls[:, t]] - np.log(np.exp(logits).sum(axis=1))
        for c in range(lm.CLUSTERS):
            f = np.flatnonzero((cls[:, t] == c) & (place[:, t] >= 0))
            inner = h[f] @ p["w"][c].T + p["wb"][c] + net.place_mask[c]
            inner -= inner.max(axis=1, keepdims=True)
            total[f] += inner[np.arange(len(f)), place[f, t]] - np.log(np.exp(inner).sum(axis=1))
    return total


def peak(f):
    """The result, and the most bytes that were held at once while it was made."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_documents_are_read_in_blocks_that_fit_a_cache():
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    n = 8 * lm.LANES
    w = cut([" ".join(vocabulary[np.minimum(rng.zipf(1.3, 31) - 1, 19_999)]) for _ in range(n)])
    hashes, counts = np.unique(lm._word_keys(w), return_counts=True)
    some = np.sort(rng.choice(len(hashes), len(hashes) // 2, replace=False))  # the other words are rare
    table = lm.Table(hashes[some], counts[some], np.zeros(len(some), int), len(w.doc) + n, len(hashes) + 1, n)
    net = lm.Net(lm.Net.start(table) * 5, table)
    at, known = table.look_up(lm._word_keys(w))
    assert (known == np.isin(lm._word_keys(w), table.hashes)).all() and (table.hashes[at[known]] == lm._word_keys(w)[known]).all()
    (got, *_), held = peak(lambda: lm.score_documents(net, w, table))
    assert np.allclose(got, plain_scores(net, table, w, n), rtol=1e-4)
    assert held < 20_000_000


def test_a_task_sends_on_each_word_once():
    text = "one two two three " * 60_000  # several runs of a batch
    assert len(text) * 6 > 3 * words.CHUNK_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 6), pa.array([3, 3, 3, 5, 5, 5], pa.int32())], names=["text", "lang"])
    rows = [(r["h"], r["lang"], r["c"]) for b in lm._count_rows(iter([batch, batch])) for r in b.to_pylist()]
    assert len(rows) == len({r[:2] for r in rows}) == 6
    assert sorted(r[2] for r in rows) == [360_000] * 4 + [720_000] * 2
