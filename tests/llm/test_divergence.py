"""Divergence audit: brute force over odd inputs, stripes that spill and merge, and many sources."""
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import divergence
from panelwright.llm.words import split, text_buffers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(docs, min_docs=3, top=200):
    docs = [((t or "").translate(LOWER), lang or "", source or "") for t, lang, source in docs]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in docs}
    for t, lang, s in docs:
        w = TERM.findall(t)
        df[lang].update(set(w))
        count[lang, s].update(w)
    out = set()
    for lang, s in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = [x for a, x in groups if a == lang]
        n = {x: sum(count[lang, x][t] for t in kept) for x in sources}
        p = lambda x, t: 1 + 10**9 * (count[lang, x][t] + 1) // (n[x] + len(kept))
        q = lambda t: 1 + 10**9 * (sum(count[lang, x][t] for x in sources) + 1) // (sum(n.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        pair = [(x, sum(f(p(s, t), p(x, t)) for t in kept)) for x in sources if x != s]
        term = [(t, f(p(s, t), q(t))) for t in kept if count[lang, s][t] and p(s, t) > q(t)]
        for part, rows in (("pair", pair), ("term", term)):
            rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
            out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(rows if part == "pair" else rows[:top], 1)}
    return out


def got(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string")
    rows = divergence.audit(df, **how).collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("top", [3, 200])
def test_audit_by_brute_force(spark, top):
    rng = np.random.default_rng(1)
    docs = [(" ".join(f"Wörd{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.zipf(1.4, rng.integers(0, 60)) % 300), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 6)}") for _ in range(150)]
    docs += [(None, "en", "s1"), ("", "en", "only empty"), ("alone", "fr", "a"), ("", "fr", "b"), ("same same Same", None, None), ("same", None, None), ("same x-y_z9", None, "s0"), ("long " * 5000, "en", "s2")]
    docs += docs[:3]
    assert got(spark, docs, top=top) == brute(docs, top=top)


def test_many_sources_and_one_hot_source(spark):
    docs = [(f"shared text of all {'own' if i % 7 else 'rare'} words", "en", "hot" if i % 3 else f"host{i}") for i in range(300)]
    assert got(spark, docs) == brute(docs)


def test_no_rows_and_one_source(spark):
    assert got(spark, []) == set()
    assert got(spark, [("a b", "en", "s")] * 3) == brute([("a b", "en", "s")] * 3)


def test_stripes_that_spill_fold_and_merge(monkeypatch):
    """However often a task folds and spills, merging its stripes by key gives the counts."""
    monkeypatch.setattr(divergence, "PENDING", 5)
    rng = np.random.default_rng(2)
    texts = [" ".join(chr(97 + k) * 2 for k in rng.integers(0, 12, rng.integers(0, 9))) for _ in range(60)]
    groups = [(f"l{i % 2}", f"s{i % 5}") for i in range(60)]
    stripes, out = divergence._Stripes(3), []
    for i in range(0, 60, 4):
        stripes.add(groups[i : i + 4], split(*text_buffers(pa.array(texts[i : i + 4])), lower=True, stops=divergence._STOPS))
        if i % 16 == 0:
            out += stripes.spill()
    out += stripes.spill()
    rows = sorted((r for b in out for r in b.to_pylist()), key=lambda r: (r["lang"], r["term"], r["salt"]))
    table = pa.Table.from_pylist([r | {"salt": 0} for r in sorted(rows, key=lambda r: (r["lang"], r["term"]))], schema=out[0].schema)
    merged = [r for b in divergence._merge_rows(table.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    df, count = Counter(), Counter()
    for t, (lang, s) in zip(texts, groups):
        df.update({(lang, w) for w in t.split()})
        count.update((lang, w, s) for w in t.split())
    assert {(r["lang"], r["term"]): r["df"] for r in merged} == df and len(merged) == len(df)
    assert {(r["lang"], r["term"], s): c for r in merged for s, c in zip(r["sources"], r["counts"])} == count


def test_rates_of_large_totals_are_exact(spark):
    cases = [(c, d) for d in (1, 7, 10**9 + 7, 10**13 + 9, 8 * 10**15) for c in (0, d // 3, d - 1)]
    rows = spark.createDataFrame(cases, "c long, d long").selectExpr("c", "d", f"{divergence.rate('c', 'd')} as p").collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.d for r in rows)
