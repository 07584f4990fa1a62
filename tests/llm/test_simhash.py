"""SimHash: fingerprints by a plain loop, classes by brute force, dense groups, blocks and odd inputs."""
import re

import numpy as np
import pytest
import xxhash

from panelwright.llm import simhash
from panelwright.llm.store import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    """Smallest index of the class of each of the values."""
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    out = np.arange(len(fps))
    while True:
        new = np.where(near, out[None], len(fps)).min(axis=1)
        if (new == out).all():
            return out.tolist()
        out = new


def got(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string, name string, label string, low int")
    return simhash.simhash_classes(df, **how).collect()


def test_fingerprints_and_classes_of_documents(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, n)) for n in (1, 3, 4, 5, 50, 400, 3000)]
    texts += [texts[5].replace(" ", "  \n") + " tail", texts[5].upper(), texts[6] + " one more", "Ünï  cödé", "ünï cödé", "Ünï cödé", "", None, " \t", "end\n", "end"]
    docs = [(i, t, "f", "n", "l", 1) for i, t in enumerate(texts)]
    want = [plain_fingerprint(t) for t in texts]
    classes = plain_classes(want)
    out = got(spark, [*docs, (None, texts[5], "f", "n", "l", 1), docs[4]])
    assert len(out) == len(docs) + 2
    for r in out:
        i = 5 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (f"{want[i]:016x}", classes[i])


@pytest.mark.parametrize("shard, visitors", [(1 << 14, 1 << 20), (64, 1 << 20), (8, 16)])
def test_classes_by_brute_force(spark, shard, visitors):
    rng = np.random.default_rng(5)
    far = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
    flips = lambda x, most: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(x), most), dtype=np.uint64), axis=1)
    near = np.concatenate([flips(far[:200], k) for k in (1, 4, 5, 6)])
    dense = flips(np.repeat(far[:1], 500), 3)  # one group of many values that lie near to each other
    fps = np.unique(np.concatenate([far, near, dense, np.zeros(1, np.uint64)]))
    table = materialize(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "fps")
    label = {r.name: r.label for r in simhash.hamming_classes(table, shard, visitors).collect()}
    mine = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
    first = {}
    assert [first.setdefault(x, i) for i, x in enumerate(mine)] == plain_classes(fps)


def test_each_pair_meets_in_one_cell_of_a_tree():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for mask, points in simhash.vantage_points(a, 6):
        low = np.uint64(int(mask) & -int(mask))
        b = a ^ np.where(np.arange(400) % 2, low, np.uint64(0))
        ra, ca, ha = simhash.cells(a, mask, points, 1)
        rb, cb, hb = simhash.cells(b, mask, points, 1)
        met = {(i, c): h for i, c, h in zip(ra.tolist(), ca.tolist(), ha.tolist())}
        both = [i for i, c, h in zip(rb.tolist(), cb.tolist(), hb.tolist()) if (h or met.get((i, c))) and (i, c) in met]
        assert sorted(both) == list(range(400))


def test_boundaries_prune():
    """Random fingerprints: shards of a tree get far fewer visitors than there are pairs of cells."""
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    for mask, points in simhash.vantage_points(fp[:4096], 6):
        row, _, home = simhash.cells(fp, mask, points, 1)
        assert home.sum() == len(fp) and len(row) < 6 * len(fp)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_a_third_of_all_rows_equal(spark):
    out = got(spark, [(i, "the same words in all of these" if i % 3 else f"text {i} of its own kind {i * i}", "f", "n", "l", 1) for i in range(300)])
    assert {r.component_id for r in out if r.doc_id % 3} == {1}
