"""HTML extraction with a site style tree.

All pages of a host are merged into one tree. An element node stands for a tag with its class and id at a place
of the tree; the runs of equal children of an element make its style, and each style that pages show at that
place is a style node with the number of its pages. Text, link targets and image sources are the features of
the element that holds them.

Siblings of one key are one element; a page counts once for each of the styles that they have there.

Importance of an element that m pages show, with share p_i of its i-th style:
presentation: - sum p_i log_m p_i (1 if m = 1); content, for an element without element children:
1 - mean, over all features as often as they are shown, of their entropy over the pages, also to the base m. Composite importance of an
inner element is (1 - GAMMA ** l) presentation + GAMMA ** l sum p_i C_i, l being its number of styles and C_i
the mean composite importance of the children in style i. What all pages repeat scores near 0, what each page
has of its own near 1. Branches below CUT are removed from each page; what stays, less scripts and the like,
is the page's text.

Styles fold repeated children, so the tree grows with a host's templates and not with its pages; counts and
entropies are sums that Spark aggregates before a host's tree is put together.

Result of ``extracted``: one row for each page: page_id, host, text, removed (branches that were cut).

Defined cases: a null or empty page gives an empty text; a null or unreadable url is the host "" (pages without
host are merged with each other); unclosed and stray tags are repaired or skipped, at any depth; a quote that is
never closed ends quoting for the rest of its page, and what follows a tag that is never closed is text; rows of one page_id are separate pages; text in no element
belongs to the page's root; a host with one page keeps all its branches.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, staged, table

GAMMA, CUT = 0.9, 0.75
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template", "head", "title"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "br", "wbr", "img"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_RAW = {"script", "style", "noscript", "template"}
#: A tag with its name and attributes; none of the parts gives back what it took, so a match costs its length at most.
_TAG = re.compile(r"""<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _RAW}
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    __slots__ = ("tag", "key", "children", "parts", "path", "links")

    def __init__(self, tag: str, key: str):
        self.tag, self.key = tag, key
        self.children: list[Node] = []
        #: texts and child nodes in order
        self.parts: list = []
        self.links: list[str] = []
        self.path = 0


def _after(page: str, what: str, at: int) -> int:
    """The place behind the next ``what``, or the page's end."""
    found = page.find(what, at)
    return len(page) if found < 0 else found + len(what)


def _tags(page: str):
    """(start, end, match or None) of the page's tags and of what is left out, in one pass.

    Only the first tag whose quotes don't close costs a look at the rest of the page: quotes mean nothing from
    there on. A tag that doesn't close ends the pass, for then no ``>`` is left."""
    at, pattern = 0, _TAG
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1 : at + 2]
        if sign in ("!", "?") and sign:
            end = _after(page, "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">", at + 2 + 2 * page.startswith("<!--", at))
            yield at, end, None
            at = end
            continue
        name = page[at + 2 : at + 3] if sign == "/" else sign
        if not (name.isascii() and name.isalpha()):
            at += 1
            continue
        m = pattern.match(page, at)
        if not m and pattern is _TAG:
            pattern = _LOOSE
            m = pattern.match(page, at)
        if not m:
            return
        end = m.end()
        if not m[1] and (raw := m[2].lower()) in _RAW:
            close = _END[raw].search(page, end)
            end = close.end() if close else len(page)
            m = None
        yield at, end, m
        at = end


def parse(page: str) -> Node:
    """The page's elements; scripts, comments and declarations are left out. Takes time in proportion to the page's
    length, whatever it holds."""
    root = Node("", "")
    # for each open element the number of the innermost block around it, and how many of each tag are open
    stack, block, opened, at = [root], [0], Counter(), 0

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:], block[k:]

    for start, end, m in _tags(page):
        if start > at:
            stack[-1].parts.append(page[at:start])
        at = end
        if m is None:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        top = stack[-1].tag
        if top in _CLOSES.get(tag, ()) or (top == "p" and tag in _ENDS_P):
            close(len(stack) - 1)
        elif tag in _ENDS_P and stack[block[-1]].tag == "p":
            close(block[-1])
        key, links = tag, []
        if len(raw) > 1:
            attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(raw)}
            key = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}"
            links = [f"{a}={attrs[a]}" for a in ("href", "src", "alt") if a in attrs]
        node = Node(tag, key)
        node.links = links
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        if tag not in _VOID and not raw.endswith("/"):
            block.append(block[-1] if tag in _INLINE else len(stack))
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _hash(*parts) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


def style(node: Node) -> tuple[str, ...]:
    """Keys of the block children, runs folded; inline children are the element's content, as its text is."""
    out: list[str] = []
    for c in node.children:
        if c.tag not in _INLINE and (not out or out[-1] != c.key):
            out.append(c.key)
    return tuple(out)


def walk(root: Node):
    """(node, its element's number, its style's number, the children's numbers) in document order, blocks only."""
    todo = [(root, _hash("root"))]
    while todo:
        node, number = todo.pop()
        node.path = number
        keys = style(node)
        own = _hash(number, *keys)
        yield node, number, own, [_hash(own, k) for k in dict.fromkeys(keys)]
        for c in reversed(node.children):
            if c.tag not in _INLINE:
                todo.append((c, _hash(own, c.key)))


def content(node: Node) -> list[str]:
    """Features of an element: its texts and links, with those of its inline children."""
    out, todo = [*node.links], [node]
    while todo:
        n = todo.pop()
        for p in n.parts:
            if isinstance(p, str):
                t = " ".join(p.split())
                if t:
                    out.append(t)
            elif p.tag in _INLINE:
                out += p.links
                todo.append(p)
    return out


_SCHEMA = "host string, kind int, element long, other long, children array<long>, n long, nlogn double"


def _observe(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of a batch: elements' styles (kind 0), features by page (kind 1) and pages of elements (kind 2)."""
    from math import log

    styles: Counter = Counter()
    pages: Counter = Counter()
    kids: dict = {}
    feats: dict = {}
    for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
        seen: Counter = Counter()
        shown: dict = {}
        for node, number, own, children in walk(parse(page or "")):
            shown.setdefault(number, {})[own] = children
            for f in content(node):
                seen[number, _hash(f)] += 1
        for number, some in shown.items():
            pages[host, number] += 1
            for own, children in some.items():
                styles[host, number, own] += 1
                kids[own] = children
        for (number, f), n in seen.items():
            a = feats.setdefault((host, number, f), [0, 0.0])
            a[0] += n
            a[1] += n * log(n)
    rows = [(h, 0, e, s, kids[s], n, 0.0) for (h, e, s), n in styles.items()] + [(h, 1, e, f, None, n, x) for (h, e, f), (n, x) in feats.items()]
    rows += [(h, 2, e, None, None, n, 0.0) for (h, e), n in pages.items()]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64()]
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "kind", "element", "other", "children", "n", "nlogn"])


def importances(styles: list[tuple[int, int, list[int], int]], content_of: dict[int, float], pages: dict[int, int] | None = None) -> dict[int, float]:
    """Composite importance of each element from (element, style, children, pages), its content importance and its
    pages (without them the sum over its styles; a page that shows several styles of an element counts once)."""
    from math import log

    by: dict[int, list] = {}
    for element, _, children, n in styles:
        by.setdefault(element, []).append((children, n))
    out: dict[int, float] = {}
    todo = list(by)
    while todo:
        e = todo[-1]
        if e in out:
            todo.pop()
            continue
        wait = [c for children, _ in by[e] for c in children if c in by and c not in out]
        if wait:
            todo += wait
            continue
        todo.pop()
        total = sum(n for _, n in by[e])
        m = (pages or {}).get(e, total)
        own = content_of.get(e)
        if not any(children for children, _ in by[e]):
            out[e] = own if own is not None else (1.0 if m == 1 else 0.0)
            continue
        shares = [n / total for _, n in by[e]]
        shown = 1.0 if m == 1 else min(1.0, -sum(p * log(p) for p in shares) / log(m))
        inner = sum(p * (sum(out.get(c, 1.0) for c in children) / len(children) if children else (own if own is not None else 0.0)) for p, (children, _) in zip(shares, by[e]))
        fade = GAMMA ** len(shares)
        value = (1 - fade) * shown + fade * inner
        out[e] = value if own is None else max(value, own)
    return out


def highest(styles: list[tuple[int, int, list[int], int]], imp: dict[int, float]) -> dict[int, float]:
    """The largest importance of each element's branch."""
    below: dict[int, set[int]] = {}
    for element, _, children, _ in styles:
        below.setdefault(element, set()).update(children)
    out: dict[int, float] = {}
    todo = list(below)
    while todo:
        wait = [c for c in below[todo[-1]] if c in below and c not in out]
        if wait:
            todo += wait
            continue
        e = todo.pop()
        out[e] = max([imp[e], *(out.get(c, 1.0) for c in below[e])])
    return out


def _noise(key, t: pa.Table) -> pa.Table:
    host = key[0].as_py()
    rows = t.to_pylist()
    styles = [(r["element"], r["other"], r["children"] or [], r["n"]) for r in rows if r["kind"] == 0]
    imp = importances(styles, {r["element"]: r["score"] for r in rows if r["kind"] == 1}, {r["element"]: r["n"] for r in rows if r["kind"] == 2})
    top = highest(styles, imp)
    low = sorted(e for e in imp if top[e] < CUT)
    return pa.table([pa.array([host], pa.string()), pa.array([low], pa.list_(pa.int64()))], names=["host", "low"])


def _text(root: Node, low: set[int]) -> tuple[str, int]:
    """Text of the branches that stay, a line for each block, and the number of branches that go."""
    lines, line, removed = [], [], 0
    for _ in walk(root):
        pass
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
            continue
        if x is None:
            lines.append(" ".join(htmllib.unescape("".join(line)).split()))
            line = []
            continue
        if x.tag in _SILENT:
            continue
        block = x.tag not in _INLINE
        if block and x.tag and x.path in low:
            removed += 1
            continue
        if block or x.tag == "br":
            todo.append(None)
        todo += reversed(x.parts)
        if block:
            todo.append(None)
    lines.append(" ".join(htmllib.unescape("".join(line)).split()))
    return "\n".join(t for t in lines if t), removed


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets: dict = {}
    texts, removed = [], []
    hosts = batch.column("host").to_pylist()
    lows = batch.column("low")
    for k, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
        if host not in sets:
            sets[host] = set(lows[k].as_py() or [])
        t, n = _text(parse(page or ""), sets[host])
        texts.append(t)
        removed.append(n)
    return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["page_id", "host", "text", "removed"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))


def low_elements(pages: DataFrame) -> DataFrame:
    """(host, low): the elements of each host whose branches are of low importance."""
    seen = arrow_map(pages.select("host", "html"), _observe, _SCHEMA)
    counts = staged(seen.groupBy("host", "kind", "element", "other").agg(F.max("children").alias("children"), F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn")), "styles")
    shown = counts.filter("kind = 2").select("host", "element", F.col("n").alias("m"))
    entropy = F.when(F.col("m") <= 1, 0.0).otherwise((F.log("n") - F.col("nlogn") / F.col("n")) / F.log("m"))
    scores = counts.filter("kind = 1").join(shown, ["host", "element"]).groupBy("host", "element").agg((1 - F.sum(entropy * F.col("n")) / F.sum("n")).alias("score"))
    tree = counts.filter("kind in (0, 2)").select("host", "kind", "element", "other", "children", "n", F.lit(None).cast("double").alias("score"))
    tree = tree.unionByName(scores.select("host", F.lit(1).alias("kind"), "element", F.lit(None).cast("long").alias("other"), F.lit(None).cast("array<long>").alias("children"), F.lit(None).cast("long").alias("n"), "score"))
    return tree.groupBy("host").applyInArrow(lambda key, t: _noise(key, t), "host string, low array<long>")


def extracted(pages: DataFrame) -> DataFrame:
    rows = with_host(pages)
    low = staged(low_elements(rows), "low")
    return arrow_map(rows.join(low, "host", "left").select("page_id", "host", "html", "low"), _extract, "page_id long, host string, text string, removed int")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op2_site_style_tree": op2_site_style_tree}
SQL: dict[str, str] = {}
