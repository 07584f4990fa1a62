"""Near duplicates: signatures, sketches and classes against all pairs."""
import numpy as np
import pytest

from panelwright.llm import jaccard


def near_pairs(seed, n, sizes):
    """Sets and edited copies of them around the threshold."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        size = int(rng.choice(sizes))
        pool = np.unique(rng.integers(0, 1 << 63, 3 * size + 40, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        a, gone, more = pool[:size], rng.integers(0, size // 4 + 2), rng.integers(0, size // 3 + 2)
        yield np.sort(a), np.sort(np.concatenate([a[gone:], pool[size : size + more]]))


def test_sketches_never_leave_out_a_link_and_know_most_others():
    kept = links = others = 0
    for a, b in near_pairs(3, 1500, [1, 2, 3, 6, 20, 60, 200, 900, 3000]):
        if not len(b):
            continue
        s = jaccard.Sketches(np.array([len(a), len(b)]), [jaccard.parity_sketch(x) for x in (a, b)])
        may, link = len(s.near(0, np.array([False, True]))) > 0, jaccard.linked(a >> np.uint64(16), b >> np.uint64(16))
        assert link == (4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)))
        assert may or not link
        links, others, kept = links + link, others + (not link), kept + (may and not link)
    assert links > 300 and others > 300 and kept < 0.6 * others  # pairs here lie about the threshold


def family(rng, words, copies, edits):
    base = [f"w{rng.integers(10**9)}" for _ in range(words)]
    for _ in range(copies):
        t = list(base)
        for k in rng.integers(0, words, rng.integers(0, edits + 1)):
            t[k] = f"x{rng.integers(10**9)}"
        yield " ".join(t)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    out = []
    for words, copies, edits in [(40, 60, 2), (200, 90, 10), (900, 25, 40), (8, 30, 1), (12, 30, 1), (120, 120, 5)]:
        out += family(rng, words, copies, edits)
    passage = " ".join(f"p{i}" for i in range(80))  # shared by many texts, alone no link
    out += [passage + " " + " ".join(f"u{rng.integers(10**9)}" for _ in range(rng.integers(5, 120))) for _ in range(60)]
    return out + out[:20] + ["", None, "one", "one", "two words"]


def classes(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [2048, 16])
def test_classes_of_all_pairs(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NAMES", block)  # small blocks: families over several tasks
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = classes(texts)
    assert 20 < sum(c < i for i, c in enumerate(want)) < len(texts) - 60
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(d).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in jaccard.keep_one(d).collect()) == sorted({c for i, c in enumerate(want) if texts[i]} | {i for i, t in enumerate(texts) if not t})


def test_one_row_of_each_class_by_its_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    d = spark.createDataFrame([(1, a, 7), (5, a, 7), (5, b, 8), (None, b, 9), (None, "alone", 9), (6, "twice", 1), (6, "twice", 1), (7, None, 0), (7, None, 0)], "doc_id long, text string, mark int")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(d).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (None, "alone"), (6, "twice"), (7, None), (7, None)], key=repr)


def test_bit_set_holds_its_entries_and_few_others(spark):
    from panelwright.llm.bitset import BitSet

    rng = np.random.default_rng(1)
    h, other = (rng.integers(0, 1 << 64, 9000, dtype=np.uint64) for _ in range(2))
    d = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    s = BitSet(d, "h")
    assert s.may_hold(h).all() and s.may_hold(other).mean() < 0.1
    assert not BitSet(d.limit(0), "h").may_hold(other).any()


@pytest.mark.parametrize("size", [1, 2, 3, 6, 12, 20, 30])
def test_distinct_short_sets_share_no_signature(size):
    """Neither an empty subset nor any other signature brings sets together that share no shingle."""
    rng = np.random.default_rng(size)
    n = 100_000 // size
    sets = np.unique(rng.integers(0, 1 << 63, n * size + 99, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(sets)
    sets = np.sort(sets[: n * size].reshape(n, size), axis=1).ravel()
    doc, sig = jaccard.signatures(sets, np.arange(0, n * size + 1, size))
    pairs = np.unique(np.stack([sig & np.uint64(jaccard.SIGNATURE_MASK), doc.astype(np.uint64)]), axis=1)
    assert len(np.unique(doc)) == n and len(np.unique(pairs[0])) >= pairs.shape[1] - 3  # 48 bits meet by chance now and then


def test_every_linked_pair_of_small_sets_meets():
    met = 0
    for size in range(1, 41):
        for a, b in near_pairs(100 + size, 150, [size]):
            if len(b) and 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
                doc, sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (size, len(a), len(b))
                met += 1
    assert met > 1500


def test_distinct_five_word_texts_form_no_families(spark):
    d = spark.range(100_000).selectExpr("id as doc_id", "concat('a', id, ' b', id * 7, ' c', id % 97, ' d e') as text")
    out = jaccard.near_duplicates(d)
    assert out.filter("component_id <> doc_id or n_shingles <> 1").count() == 0 and out.count() == 100_000
