"""Main text of pages: marked-up chrome goes, and lines that the pages of nearest URL on the host share."""
from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, read_table

#: A quote opens an attribute value only after an equals sign; an open tag at the end of a page ends there.
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:/?[a-zA-Z](?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+|[!?][^>]*+)(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Elements whose content runs to their own literal end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CHROME = frozenset("head nav header footer aside form menu dialog button select datalist fieldset template svg math object canvas".split()) | RAW
BLOCK = frozenset("html body p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article main section table tr td th thead tbody tfoot caption blockquote pre figure figcaption address details summary center".split())
#: A class, id or role that is one of these names marks its element as a menu, header, footer, sidebar, notice, advert, form or comments.
CHROME_NAME = re.compile(r"(?i)(?:ads?|adverts?|advertisement|sponsored|promo|banner|cookies?|cookie[-_](?:banner|notice|bar|consent)|consent|notice|popup|modal|menu|nav|navbar|navigation|breadcrumbs?|side-?bar|complementary|header|site[-_]header|masthead|footer|site[-_]footer|contentinfo|comments?|comment[-_](?:list|section|area|form)|replies|respond|disqus_thread|share|social|related|newsletter|subscribe|search|pagination)")
NAMED = re.compile(r"(?i)(?<=[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HIDDEN = re.compile(r"(?i)\shidden(?=[\s/>=])(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements whose start ends an open one of the second set, unless one of the third stands between them.
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
}
SPACE = re.compile(r"\s+")
#: In a marked article, shared lines with more than this part of its text make the two pages versions of one article.
VERSION_SHARE = 0.5
#: Pages of a range, about, and ranges at most: a range is one task's sorted run.
RANGE_PAGES, MAX_RANGES = 2000, 4096


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Text blocks in page order, and whether they stand in a marked article (article, else main).

    A list item, cell, paragraph or term ends where the next one starts, and every element at the end of its parent.
    """
    if not page:
        return [], False
    lines: list[tuple[str, int]] = []  # text and where it stands: 2 in article, 1 in main, 0 elsewhere
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are left out
    places: dict[str, list[int]] = {}  # of each name, where its open elements stand in the stack
    bad = 0
    inside = {"article": 0, "main": 0}

    def flush():
        line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if line:
            lines.append((line, 2 if inside["article"] else 1 if inside["main"] else 0))
        text.clear()

    def close_to(depth: int):
        nonlocal bad
        while len(stack) > depth:
            name, out = stack.pop()
            places[name].pop()
            bad -= out
            if name in inside:
                inside[name] -= 1

    def innermost(names, barrier):
        last = lambda those: max((places[n][-1] for n in those if places.get(n)), default=-1)
        k = last(names)
        return k if k > last(barrier) else None

    at, end = 0, len(page)
    while at < end:
        m = PIECE.match(page, at)
        p, at = m[0], m.end()
        if p[0] != "<" or len(p) == 1:
            if not bad:
                text.append(p)
            continue
        if p[1] in "!?":
            if p.startswith("<![CDATA[") and not bad:
                text.append(p[9:].removesuffix("]]>").replace("&", "&amp;").replace("<", "&lt;"))
            continue
        close, name = p[1] == "/", NAME.match(p)[1].lower()
        if name in BLOCK or name in CHROME:
            flush()
        if close:
            k = innermost((name,), ("table", "article", "main") if name in ("p", "li", "dd", "dt", "b", "i", "a", "span") else ())
            if k is not None:
                close_to(k)
            continue
        if name in _CLOSES_P and (k := innermost(("p",), frozenset("table td th button article aside nav header footer form".split()))) is not None:
            close_to(k)
        if name in IMPLIED and (k := innermost(*IMPLIED[name])) is not None:
            close_to(k)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if p.endswith("/>"):
            continue
        tokens = " ".join(x or y or z for x, y, z in NAMED.findall(p)).split() if "=" in p else ()
        out = (name in CHROME and not (name == "header" and inside["article"])) or (name not in ("html", "body") and (any(CHROME_NAME.fullmatch(x) for x in tokens) or bool(HIDDEN.search(p))))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, out))
        bad += out
        if name in inside:
            inside[name] += 1
    flush()
    best = max((k for _, k in lines), default=0)
    return [t for t, k in lines if k == best], best > 0


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices in a of a longest common subsequence of the two lists, by bit rows; halved until the rows fit in 8 MB."""
    shared, wanted = set(b), set(a)
    at = [i for i, x in enumerate(a) if x in shared]
    code: dict[str, int] = {}
    x = [code.setdefault(a[i], len(code)) for i in at]
    y = [code[t] for t in b if t in wanted]
    return {at[i] for i in _align(x, y, 0)}


def _rows(x, y):
    """After each item of x: the bits of y at which the common length does not grow."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        m = row & where.get(v, 0)
        row = ((row + m) | (row - m)) & full
        yield row


def _align(x, y, base):
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    out = [*range(base, base + lo), *range(base + len(x) - hi, base + len(x))]
    x, y, base = x[lo : len(x) - hi], y[lo : len(y) - hi], base + lo
    if not x or not y:
        return out
    if len(x) == 1:
        return out + ([base] if x[0] in y else [])
    if len(x) * len(y) > 1 << 26:
        half = len(x) // 2

        def lengths(p, q):
            for row in _rows(p, q):
                pass
            bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(q) // 8), "little"), np.uint8), bitorder="little")[: len(q)]
            return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

        j = int((lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return out + _align(x[:half], y[:j], base) + _align(x[half:], y[j:], base + half)
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # no growth at this place of y
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # the growth was there before x[i - 1]
            i -= 1
        else:
            out.append(base + i - 1)
            i, j = i - 1, j - 1
    return out


def main_text(lines: list[str], marked: bool, nearest: list[str] | None, other: list[str] | None) -> tuple[str, int]:
    """Blocks joined by one space, without those that the neighbours show to be chrome, and the number of those that went.

    Without a marked article all lines that the page of nearest URL shares go; a page with no line of its own keeps all.
    In a marked article a line goes if both neighbours share it (one alone may quote it), unless the shared lines are
    most of the article: then the pages are versions of one article.
    """
    if nearest is None:
        return " ".join(lines), 0
    gone = common_lines(lines, nearest)
    if marked:
        gone = gone & common_lines(lines, other) if other is not None and gone else set()
        if sum(len(lines[i]) for i in gone) > VERSION_SHARE * sum(map(len, lines)):
            gone = set()
    elif len(gone) == len(lines):
        gone = set()
    return " ".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
NOT_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$"


def _keyed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, HOST, 1)).alias("host"), F.regexp_replace(url, NOT_PATH, "").alias("path"), F.xxhash64(body).alias("h"), body.alias("html"))


def ranges(keyed: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Places (host, path, h) at which a new range starts, and those of the last page before each: at most MAX_RANGES.

    Keys alone are sorted and numbered; the ranges follow from their number, so results do not depend on partitions.
    """
    spread = keyed.select("host", "path", "h").distinct().repartitionByRange("host", "path", "h").sortWithinPartitions("host", "path", "h")
    keys = materialize(spread.select("host", "path", "h", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "page_keys")
    parts = keys.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = parts.select("part", "first", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("to"), "n")
    total = keys.count()
    step = max(RANGE_PAGES, -(-total // MAX_RANGES))
    place = (F.col("at") - F.col("first") + F.col("to") - F.col("n")).alias("place")
    edge = keys.join(F.broadcast(parts), "part").select("host", "path", "h", place).filter((F.col("place") % step == 0) | (F.col("place") % step == step - 1))
    rows = sorted(tuple(r.values()) for r in edge.select("place", "host", "path", "h").toArrow().to_pylist())
    starts = [r for r in rows if r[0] % step == 0 and r[0]]
    before = [r for r in rows if r[0] % step == step - 1]
    return [r[1:] for r in starts], [r[1:] for r in before]


def _parse(shared):
    def run(batches):
        starts, before = shared.value
        keys = [tuple(x) for x in starts]
        first = {k: i for i, k in enumerate(keys)}  # the first page of a range also closes the range before it
        last = {tuple(k): i for i, k in enumerate(before)}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = []
            for page_id, url, host, path, h, page in zip(*(batch.column(k).to_pylist() for k in range(6))):
                place = (host, path, h)
                r = bisect_right(keys, place)
                lines, marked = blocks(page)
                out.append((r, host, path, h, False, page_id, url, lines, marked))
                if place in first:
                    out.append((first[place], host, path, h, True, page_id, url, lines, marked))
                if place in last:
                    out.append((last[place] + 1, host, path, h, True, page_id, url, lines, marked))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return run


_SCHEMA = "r int, host string, path string, h long, context boolean, page_id long, url string, lines array<string>, marked boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _difference(batches):
    """Rows come sorted by range, host, path and content; copies in a row are one page with several ids."""

    def runs_of_copies():
        key, ids, page = None, [], None
        for batch in batches:
            for small in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for r, host, path, h, context, page_id, url, lines, marked in zip(*(small.column(k).to_pylist() for k in range(9))):
                    if key != (r, host, h):
                        if key is not None:
                            yield key, ids, page
                        key, ids, page = (r, host, h), [], (path, lines, marked)
                    if not context:
                        ids.append((page_id, url))
        if key is not None:
            yield key, ids, page

    def answer(before, row, after):
        key, ids, (path, lines, marked) = row
        if not ids:
            return []
        near = [x[2] for x in (before, after) if x and x[0][:2] == key[:2]]
        near.sort(key=lambda x: -_prefix(x[0], path))  # stable: of two as near the one before
        text, n = main_text(lines, marked, near[0][1] if near else None, near[1][1] if len(near) > 1 else None)
        return [(i, u, text, len(text), n) for i, u in ids]

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["page_id", "url", "text", "n_chars", "n_shared_lines"])

    before = row = None
    out: list = []
    for after in runs_of_copies():
        if row:
            out += answer(before, row, after)
        before, row = row, after
        while len(out) >= 256:
            yield pack(out[:256])
            out = out[256:]
    if row:
        out += answer(before, row, None)
    for i in range(0, len(out), 256):
        yield pack(out[i : i + 256])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared_lines (lines that the differencing deleted) of every row.

    A null or empty page gives the empty text; a page alone on its host has nothing to differ from; repeated rows and
    URLs stay. The neighbours of a page are the nearest ones before and after it by (host, path, content) whose content
    differs, so copies do not count as neighbours; ties of nearness go to the page before. Pages are dealt out in ranges
    of that order, and the page at each end of a range goes to both sides of the cut.
    """
    keyed = _keyed(pages)
    shared = pages.sparkSession.sparkContext.broadcast(ranges(keyed))
    n = len(shared.value[0]) + 1
    dealt = keyed.mapInArrow(_parse(shared), _SCHEMA).repartition(n, "r").sortWithinPartitions("r", "host", "path", "h", "context")
    return dealt.mapInArrow(_difference, "page_id long, url string, text string, n_chars long, n_shared_lines long")


def op3_page_differencing(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


QUERIES = {"op3_page_differencing": op3_page_differencing}
ORACLES: dict = {}
