"""The whole pipeline against plain loops, row by row, and over odd tables."""
import hashlib
import math
import re

import pytest
from test_decontamination import plain_bm25
from test_near_duplicates import classes

import corpus_pipeline as C
from panelwright.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows, item = [], " ".join(f"item{k}" for k in range(25))
    own = lambda i, n: " ".join(f"d{i}x{k}" for k in range(n))
    line = "Sign up for the letter"
    for i in range(70):
        rows.append((i, f"{own(i, 30 + i % 9)}\n{line.upper() if i % 2 else line}", ("en", "de", None)[i % 3], "s0"))
    rows += [(100 + i, f"{own(3, 30 + 3)} tail{i}\n{line}", "en", "s0") for i in range(6)]  # near copies of 3
    rows += [(120, rows[4][1], "en", "s1"), (121, own(121, 5), "en", "s1"), (122, None, "en", "s1"), (123, "", None, None), (124, "a b c d e " * 20, "en", "s1")]
    rows += [(130, f"{own(130, 20)} {item} {own(131, 20)}", "de", "s1"), (131, f"{own(132, 20)} {item.replace('item7', 'edited')}", "de", "s1"), (None, own(133, 40), "fr", "s2"), (140, f"{own(140, 40)} | x", "en", "s2")]
    rows += [(150 + i, f"{own(150 + i, 20)} " + "|", "en", "s2") for i in range(8)]
    rows += [rows[10], (10, own(500, 30), "en", "s0")]  # a repeated row, and its doc_id with another text
    return [(*r, len(r[1] or "")) for r in rows], [(1, item), (2, None), (3, "not in any document at all here")]


def lines_of(t):
    return [(x, tuple(w.translate(LOWER) for w in WORD.findall(x))) for x in (t or "").split("\n")]


def quality(rows):
    hosts, where = {}, {}
    for i, t, lang, s, n in rows:
        text = tuple(w.translate(LOWER) for w in WORD.findall(t or ""))
        hosts.setdefault(s or "", set()).add(text)
        for _, w in lines_of(t):
            if w:
                where.setdefault((s or "", w), set()).add(text)
    bad = {k for k, v in where.items() if len(v) > 30 and len(v) > 0.05 * len(hosts[k[0]])}
    for i, t, lang, s, n in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        repeated = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)}
        left = len(w) - sum(len(x) for _, x in lines_of(t) if (s or "", x) in bad)
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and left >= 10 and left >= 0.3 * len(w):
            t = "\n".join(x for x, y in lines_of(t) if not (y and (s or "", y) in bad))
            yield (i, t, lang, s, len(t))


def draw(*parts):
    return (int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def mix(rows):
    cell = lambda r: (r[3] or "?", r[2] or "?", next((n for n, p in mixing.TOPICS if re.search(p, r[1] or "")), "prose"))
    n = {}
    for r in rows:
        n[cell(r)] = n.get(cell(r), 0) + len(WORD.findall(r[1] or ""))
    total, w = sum(n.values()), {k: float(v) for k, v in n.items()}
    marginal = lambda d, v, x: sum(y for k, y in x.items() if k[d] == v)
    target = []
    for d in range(3):
        share = {v: (marginal(d, v, n) / total) ** 0.8 for v in {k[d] for k in n}}
        target.append({v: x * total / sum(share.values()) for v, x in share.items()})
    for _ in range(12):
        for d in range(3):
            now = {v: marginal(d, v, w) for v in target[d]}
            w = {k: x * target[d][k[d]] / now[k[d]] for k, x in w.items()}
    multiple, goal = {k: w[k] / n[k] for k in n}, mixing.BUDGET * total
    full = {k for k in n if sum(n[j] for j in n if multiple[j] >= multiple[k]) + sum(w[j] for j in n if multiple[j] < multiple[k]) / multiple[k] <= goal}
    c = (goal - sum(n[k] for k in full)) / sum(w[k] for k in n if k not in full)
    return [r for r in rows if draw(8, r[0]) < (1 if cell(r) in full else min(1, multiple[cell(r)] * c))]


def shards(rows):
    for r in rows:
        score = [1 / -math.log(draw(r[0], s)) for s in range(9)]
        yield r[0], len(r[1].encode()) + 1, score[:8].index(max(score[:8])), score.index(max(score))


def test_every_stage_by_plain_loops(spark, monkeypatch):
    rows, items = corpus()
    table = lambda r, s: spark.createDataFrame(r, s)
    monkeypatch.setattr(C, "read_table", lambda spark, sf, name: table(items, "item_id long, text string") if name == "benchmark" else table(rows, SCHEMA))
    key = lambda r: repr(tuple(r))
    docs, want = table(rows, SCHEMA), rows
    for name, stage in C.STAGES:
        docs = stage(spark, docs, "")
        if name == "quality_rules":
            want = list(quality(want))
            assert 60 < len(want) < len(rows) and not any("letter" in r[1].lower() for r in want if r[3] == "s0")
        elif name == "near_duplicates":
            group = classes([r[1].translate(LOWER) for r in want])
            rank = lambda k: (want[k][0] is None, want[k][0] or 0)
            kept, seen = [], {}
            for k in sorted(range(len(want)), key=rank):
                if group[k] not in seen:
                    seen[group[k]] = k
                    kept.append(want[k])
            assert len(want) - len(kept) > 5
            want = kept
        elif name == "decontamination":
            texts = [t for _, t in items if t]
            hit = {d for d, _ in plain_bm25(texts, [r[1] for r in want])}
            assert len(hit) == 2
            want = [r for k, r in enumerate(want) if k not in hit]
        elif name == "mixing":
            want = mix(want)
        if name == "sharding":
            got = docs.collect()
            assert sorted((r.doc_id is None, r.doc_id, r["size"], r.shard, r.grown_shard) for r in got) == sorted((i is None, i, n, s, g) for i, n, s, g in shards(want))
            for s in range(8):
                assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        else:
            assert sorted(map(key, docs.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str) == sorted(map(key, want), key=str), name
    ran = C.run(spark, "").collect()
    assert sorted(map(key, ran)) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", None, None, 0)] * 3])
def test_odd_tables_through_all_stages(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "read_table", lambda spark, sf, name: spark.createDataFrame([], "item_id long, text string") if name == "benchmark" else spark.createDataFrame(rows, SCHEMA))
    assert C.run(spark, "").count() == 0
