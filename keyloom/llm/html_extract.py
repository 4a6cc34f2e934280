"""HTML extraction by composite text density.

A tolerant parser builds the DOM. For every node the link-adjusted characters per tag are computed;
the densities of its children are summed, a run of text of its own counting as one child, and the
subtree with the greatest sum is selected, or the widest one around it that is at least half as
dense, or an article or main around it that is as dense as the page. The least density on its path to
the body is the threshold: a list of links below it is left out, every other block at or above it is
kept too, and so are headings right before what is kept.

Only what is never shown as text (scripts, styles, the head, controls, hidden elements) is taken away
first. Names such as nav, aside, footer and class words take nothing away: they make the density of a
node DOUBT times as large. Forms and class words aren't doubted where they hold more than half of
the page's text. Null and empty pages give an empty text; repeated rows each give a row.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renumbered

# Element names and class words.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROP = {"button", "canvas", "datalist", "head", "iframe", "input", "noscript", "object", "script", "select", "style", "svg", "template", "textarea"}
DOUBTED = {"aside", "dialog", "footer", "form", "menu", "nav"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
BAD = {"ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|</?[a-zA-Z][^\s/<>]*+(?:[^<>"']|"[^"]*"|'[^']*')*+>""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?|"[^"]*"|'[^']*'""")
OPINIONS = {"comment", "comments", "replies"}
DOUBT = 1 / 64
# Words that say where or how large a thing is, not what: beside them a class word still counts.
PLACES = {"area", "bar", "block", "body", "bottom", "box", "column", "container", "content", "global", "group", "header", "holder", "inner", "items", "left", "links", "list", "main", "outer", "page", "panel", "post", "right", "section", "site", "text", "top", "wrap", "wrapper", "zone"}


class Node:
    __slots__ = ("tag", "kids", "drop", "doubt", "light", "up", "c", "t", "lc", "lt", "d", "sum")

    def __init__(self, tag: str, up, drop: bool = False):
        self.tag, self.up, self.drop, self.kids = tag, up, drop, []
        self.doubt = self.light = False  # light: the doubt goes if the node holds most of the page's text
        self.c = self.t = self.lc = self.lt = 0
        self.d = self.sum = 0.0


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a tag; the first of each name, as browsers have it."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw, NAME.match(raw).end()):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def judge(n: Node, raw: str, in_article: bool):
    """Marks a node that is never shown, or that its name, role or class words speak against."""
    a = attributes(raw)
    n.drop = n.tag in DROP or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
    named = class_words(n.tag, a)
    sure = n.tag in DOUBTED - {"form"} or n.tag == "header" and not in_article or a.get("role", "").lower() in ROLES or bool(named & OPINIONS)
    n.doubt = sure or n.tag == "form" or bool(named)
    n.light = n.doubt and not sure


def class_words(tag: str, a: dict[str, str]) -> set:
    """Words of class and id that name boilerplate, from names that say nothing else."""
    out = set()
    if tag not in ("html", "body", "article", "main"):
        for name in (a.get("class", "") + " " + a.get("id", "")).lower().split():
            words = {w for w in re.split(r"[^a-z]+", name) if w}
            if words and words <= BAD | PLACES:
                out |= words & BAD
    return out


def path(n):
    while n is not None:
        yield n
        n = n.up


class Opened:
    """The open elements; where the last one of each name stands is known without a climb."""

    def __init__(self):
        self.stack = [Node("html", None)]
        self.last: dict[str, list[int]] = {}
        self.walls: list[int] = [0]  # blocks other than p

    def push(self, n: Node):
        self.last.setdefault(n.tag, []).append(len(self.stack))
        if n.tag in BLOCK and n.tag != "p":
            self.walls.append(len(self.stack))
        self.stack.append(n)

    def depth(self, tag: str) -> int:
        return self.last[tag][-1] if self.last.get(tag) else 0

    def close(self, depth: int):
        """Closes the element at a depth and all inside it; depth 0 closes nothing."""
        while depth and len(self.stack) > depth:
            self.last[self.stack.pop().tag].pop()
            if self.walls[-1] == len(self.stack):
                self.walls.pop()

    def end(self, tag: str):
        depth = self.depth(tag)
        if tag in BLOCK or depth > max(self.walls[-1], self.depth("p")):
            self.close(depth)

    def implied(self, tag: str):
        """Ends that a start tag implies."""
        if tag in CLOSES_P and self.depth("p") > self.walls[-1]:
            self.close(self.depth("p"))
        if tag in SAME:
            holder = max(map(self.depth, HOLDS[tag]))
            self.close(min((d for d in map(self.depth, SAME[tag]) if d > holder), default=0))
        if tag == "body" and len(self.stack) > 1:
            self.close(1)


def parse(page: str) -> Node:
    opened = Opened()
    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        if (m.start() if m else size) > pos:
            opened.stack[-1].kids.append(html.unescape(page[pos : m.start() if m else size]))
        if not m:
            break
        pos, raw = m.end(), m[0]
        name = NAME.match(raw)
        if not name or name[1].lower() == "html":
            continue
        tag = name[1].lower()
        if raw[1] == "/":
            if tag != "body":
                opened.end(tag)
            continue
        opened.implied(tag)
        n = Node(tag, opened.stack[-1])
        judge(n, raw, bool(opened.depth("article") or opened.depth("main")))
        n.up.kids.append(n)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I | re.A).search(page, pos)
            stop = page.find(">", end.end()) if end else -1
            n.kids.append(html.unescape(page[pos : end.start() if stop >= 0 else size]))
            pos = stop + 1 if stop >= 0 else size
            n.drop = n.drop or tag == "title"
        elif tag not in VOID:
            opened.push(n)
    return opened.stack[0]


def ordered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    return out


def weighed(nodes: list[Node]) -> dict[int, float]:
    """What doubts leave of the density of each node; doubts of the nodes around it count as well."""
    size, left = {}, {}
    for n in reversed(nodes):
        size[id(n)] = sum(len(k.strip()) if isinstance(k, str) else size.get(id(k), 0) for k in n.kids)
    for n in nodes:
        n.doubt = n.doubt and not (n.light and 2 * size[id(n)] > size[id(nodes[0])])
        left[id(n)] = (DOUBT if n.doubt else 1.0) * (left[id(n.up)] if n.up is not None else 1.0)
    return left


def density(c: float, t: float, lc: float, lt: float, share: float) -> float:
    """Composite text density of c characters in t tags, lc and lt of them in links."""
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
    return c / t * math.log(max(c * t / (lc * lt), 1.0)) / (math.log(base) + 1.0)


def measure(root: Node) -> list[Node]:
    nodes = ordered(root)
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.c += len(k) - k.count(" ")
            elif not k.drop:
                n.c, n.t, n.lc, n.lt = n.c + k.c, n.t + k.t + 1, n.lc + k.lc, n.lt + k.lt
        if n.tag == "a":
            n.lc, n.lt = n.c, n.t + 1
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.lc / max(body.c, 1)
    left = weighed(nodes)
    for n in nodes:
        n.d = left[id(n)] * density(n.c, n.t, n.lc, n.lt, share) if n.c else 0.0
    for n in nodes:
        run = sum(len(k) - k.count(" ") for k in n.kids if isinstance(k, str))
        n.sum = sum(k.d for k in n.kids if isinstance(k, Node) and not k.drop) + (left[id(n)] * density(run, 1, 0, 0, share) if run else 0.0)
    return nodes


def headings(n: Node, best: Node, way: set, chosen) -> set:
    """Headings directly before a child that is kept or holds the best node."""
    out, run = set(), []
    for k in n.kids:
        if isinstance(k, str):
            run = run if not k.strip() else []
        elif k.tag in HEADINGS and not k.drop:
            run.append(id(k))
        elif not k.drop:
            out.update(run if k is best or id(k) in way or chosen(k) else ())
            run = []
    return out


def extract(page: str) -> str:
    root = parse(page)
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.sum)
    if not best.c:
        return ""
    while best.up is not None and best.tag not in BLOCK:
        best = best.up
    least = best.d / 2
    body = next((n for n in nodes if n.tag == "body"), root)
    for n in path(best.up):
        if n.d >= (min(least, body.d) if n.tag in ("article", "main") else least):
            best = n
    threshold = min(n.d for n in path(best) if n.up is not None or n is best)
    way = {id(n) for n in path(best.up)}
    blocks: list[list[str]] = [[]]

    def listing(n):
        return n.tag in ("ul", "ol", "div", "section", "table") and n.d < threshold and 2 * n.lc > n.c

    def chosen(n):
        """Other blocks as dense as the threshold, unless mostly links."""
        return n.tag in BLOCK and n.c and n.d >= threshold and 2 * n.lc <= n.c

    # An own stack: pages can be nested deeper than Python calls. Below a kept node everything is kept.
    todo: list = [(root, root is best)]
    while todo:
        n, kept = todo.pop()
        if n is None:
            blocks.append([])
        elif isinstance(n, str):
            blocks[-1] += [n] * kept
        elif not n.drop and not (kept and n is not best and (listing(n) or n.doubt and n.d < threshold)):
            kept = kept or n is best or id(n) not in way and bool(chosen(n))
            inner = n.tag in BLOCK
            heads, kids = headings(n, best, way, chosen) if not kept else (), n.kids
            todo += [(None, kept)] * inner + [(" ", kept)] * (n.tag == "br") + [(k, kept or id(k) in heads) for k in reversed(kids)] + [(None, kept)] * inner
    return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


SCHEMA = "page_id string, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page; map only, no shuffle."""

    def run(frames):
        for f in frames:
            got = [extract(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": got, "n_chars": [len(t) for t in got]})

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return renumbered(rows.mapInPandas(run, SCHEMA), pages, "page_id")
