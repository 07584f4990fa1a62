"""Main text of pages: blocks, alignment, and what the differencing decides, against brute force."""
import random

import pytest

from panelwright.llm import html

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(html.common_lines(a, b))
        rest = iter(b)
        assert len(got) == longest(a, b) and all(any(a[i] == y for y in rest) for i in got)


def test_alignment_in_halves():
    rng = random.Random(6)
    a, b = ([rng.randint(0, 3) for _ in range(9000)] for _ in range(2))
    rows = list(html._rows(a, b))
    got = sorted(html._align(a, b, 0))
    rest = iter(b)
    assert len(got) == len(b) - bin(rows[-1]).count("1") and all(any(a[i] == y for y in rest) for i in got)


@pytest.mark.parametrize("page, lines", [
    ('<article><p class="ad">buy<p>One.<p>Two.</article>', ["One.", "Two."]),
    ("<article><script>for(i=0;i<n;i++){} // don't</script><p>It's the article", ["It's the article"]),
    ('<article><p class="legal">Legal text</p><div class="article-notice-board">Board</div></article>', ["Legal text", "Board"]),
    ('<ul><li class="menu">a<li>b</ul>c', ["b", "c"]),
    ("<p title=don't>x &amp;\n y</p> 1 < 2", ["x & y", "1 < 2"]),
    ("<table><tr><td class=ad>1<td>2<tr><td>3</table>", ["2", "3"]),
    ('<form><input><p>no</p></form><style>p{}</style><div id="comments"><p>me</div><main><p>yes<aside>side</aside></main>', ["yes"]),
    ("", []), ("<div hidden>x</div>", []), ("<p>open <b>bold", ["open bold"]),
])
def test_blocks(page, lines):
    assert html.blocks(page)[0] == lines


def site(n=40, seed=2):
    """Pages of two hosts without an article element: shared menu and footer around text of their own; copies and odd rows."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        host = "a.example" if i % 3 else "b.example"
        own = [f"Own line {i} {k} {rng.random()}" for k in range(rng.randint(0, 4))]
        chrome = [f"Menu of {host}", "Home About"], [f"Imprint {host}"]
        rows.append((i, f"https://{host}/p/{i:03d}?q={i}", "".join(f"<p>{x}</p>" for x in [*chrome[0], *own, *chrome[1]])))
    rows += [rows[5], rows[5], (100, "https://a.example/p/005b", rows[5][2]), (101, None, None), (102, "https://c.example/", "<p>alone</p>"), (103, "https://a.example/p/006", "")]
    return rows


def by_hand(rows, differ=True):
    """The same rule over all pages of a host in one list."""
    order, out = {}, {}
    for i, u, p in rows:
        u = u or ""
        host, _, path = u.split("//", 1)[1].partition("/") if "//" in u else ("", "", "")
        order.setdefault(host, []).append(("/" + path.split("?")[0] if u else "", p or "", i, u))
    for pages in order.values():
        runs = []  # neighbouring copies are one page
        for path, p, i, u in pages:
            runs.append([path, p, [(i, u)]])
        runs.sort(key=lambda x: (x[0], hash_of[x[1]]))
        merged = []
        for r in runs:
            if merged and merged[-1][1] == r[1]:
                merged[-1][2] += r[2]
            else:
                merged.append(r)
        for k, (path, p, ids) in enumerate(merged):
            near = [merged[j] for j in (k - 1, k + 1) if 0 <= j < len(merged)]
            near.sort(key=lambda x: -html._prefix(x[0], path))
            lines, marked = html.blocks(p)
            text, _ = html.main_text(lines, marked, *(([html.blocks(x[1])[0] for x in near] + [None, None])[:2] if differ else (None, None)))
            for i, u in ids:
                out.setdefault((i, u), []).append(text)
    return out


hash_of: dict = {}


def test_pages_by_brute_force_whatever_the_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(html, "RANGE_PAGES", 7)  # many cuts
    rows = site()
    d = spark.createDataFrame(rows, SCHEMA)
    hash_of.update({r.t: r.h for r in d.select(F.coalesce("html", F.lit("")).alias("t"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("h")).collect()})
    want = {k: sorted(v) for k, v in by_hand(rows).items()}
    for parts in (1, 9):
        got: dict = {}
        for r in html.extract_main_text(d.repartition(parts)).collect():
            got.setdefault((r.page_id, r.url or ""), []).append(r.text)
            assert r.n_chars == len(r.text)
        assert {k: sorted(v) for k, v in got.items()} == want
    off = {k: sorted(v) for k, v in by_hand(rows, differ=False).items()}
    changed = [k for k in want if want[k] != off[k]]
    assert len(changed) > 20 and not any("Menu" in t or "Home" in t for k in changed for t in want[k])


def test_versions_of_an_article_and_quotes_in_one_stay(spark):
    art = lambda *ps: "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>"
    long = [f"Paragraph {k} of the article with some words" for k in range(6)]
    rows = [(i, f"https://h.example/{i}", art("Subscribe now", f"Head {i}", f"Body of {i} is long enough to stand", f"More of {i}")) for i in range(4)]
    rows += [(10 + i, f"https://v.example/{i}", art(*long, f"Edit {i}")) for i in range(3)]
    rows += [(20, "https://q.example/1", art("Said once", "x of its own")), (21, "https://q.example/2", art("Said once", "y of its own"))]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "Subscribe" not in got[1] + got[2] and "Head 1" in got[1]
    assert all(got[10 + i] == " ".join([*long, f"Edit {i}"]) for i in range(3))
    assert got[20].startswith("Said once") and got[21].startswith("Said once")


def test_empty_table_extra_columns_and_long_pages(spark):
    d = spark.createDataFrame([(1, "https://h/1", "<p>" + "w " * 200000 + "</p>", 5, "x")], SCHEMA + ", r int, host string")
    assert html.extract_main_text(d).first().n_chars == 399999
    assert html.extract_main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<b>x</i>", "<div><p>x", "<table><tr><td>x", "<li>x</ul>", "<span>"])
def test_parsing_is_linear_in_tags(piece):
    """Unmatched and nested elements: the stack of open ones grows to 200,000."""
    import time

    page = "<html><body><article>" + piece * (200_000 // piece.count("<")) + "end"
    t = time.process_time()
    lines, marked = html.blocks(page)
    assert time.process_time() - t < 20 and marked and lines[-1].endswith("end")
