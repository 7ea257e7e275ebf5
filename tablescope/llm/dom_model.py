"""HTML main-text extraction with a tree-structured graphical model (operator 3).

The DOM of a page is a tree of binary variables, content or not. Each node has a potential from its features, each
edge one from the kinds of its ends; both are learned from labelled pages. Messages pass from the leaves to the root
and back (sum-product), which gives the exact marginal of every text run; runs that are content by more than a half
are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose contents are never text of the page.
SILENT = {"svg", "object", "canvas", "select", "button", "math"}
#: Elements whose contents are plain characters up to their own end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
#: Characters of a tag up to its end or to the equals sign before a quoted value.
TO_QUOTE = re.compile(r"(?:[^>=]+|=(?!\s*[\"']))*+")
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Start tags that end an open element: tag -> (elements ended, elements that stop the search).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that speak against or for an element, and elements that do; fixed prior knowledge.
AGAINST = {"ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary",
           "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disqus", "discussion", "footer", "form", "gdpr", "header", "login", "masthead",
           "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promotion", "recommended", "related",
           "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription",
           "tags", "toolbar", "topbar", "warning", "widget"}
FOR = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}
AGAINST_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"}
#: Parts of a name that turn it into a state of the page ("no-sidebar", "post-with-comments"), which says nothing about the element.
STATES = {"no", "not", "without", "with", "has", "have", "hide", "hidden", "off", "is", "enabled", "disabled", "layout"}
FOR_TAGS = {"article", "main"}
PRIOR = 5.0
#: Evidence that settles a node: what the words above name is not content unless the page's article lies inside it.
CERTAIN = 1000.0
#: Most that the features of one node may say; what lies in a marked article starts with as much in its favour.
EVIDENCE = 3.0
#: Elements that mean little by themselves, whatever the labelled pages use them for.
NEUTRAL = {"div", "section", "span", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th", "center", "figure", "blockquote", "pre", "main", "body", "html"}


@dataclass
class Node:
    tag: str
    parent: int
    features: list[str]
    prior: float = 0.0
    text: list[str] = field(default_factory=list)  # of a text run
    linked: int = 0  # characters inside links
    landmark: int = 0  # 1 inside the labelled article, -1 inside something that is not


def _against(name: str) -> bool:
    """Whether one class, id or role names something that is not the article."""
    parts = set(re.findall(r"[a-z]+", name))
    if name in AGAINST:
        return True
    if parts & STATES or ("header" in parts and parts & FOR):  # "entry-header" holds the headline
        return False
    return bool(parts & AGAINST)


def _element(tag: str, attributes: str, parent: int) -> Node:
    node = Node(tag, parent, [f"tag {tag}"])
    names: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            names |= set(value.split())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            node.prior -= CERTAIN
    words = {w for n in names for w in re.findall(r"[a-z]+", n)}
    node.features += [f"name {w}" for w in sorted(words)]
    if tag not in ("html", "body", *FOR_TAGS) and (tag in AGAINST_TAGS or any(_against(n) for n in names)):
        node.prior -= CERTAIN
        node.landmark = -1
    elif tag in FOR_TAGS or words & FOR:
        node.prior += PRIOR / 2
        node.landmark = 1 if tag in FOR_TAGS else 0
    return node


class _Scanner:
    """The tokens of a page from left to right; every character is looked at a bounded number of times.

    A tag without an end reaches to the end of the page. A quote opens a value only after an equals sign and if it is closed.
    """

    def __init__(self, page: str):
        self.page, self.low = page, page.lower() if page.isascii() else "".join(c.lower() if c.isascii() else c for c in page)
        self.beyond: dict[str, int] = {}  # what is not found is not looked for again
        self.last: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if self.beyond.get(what, len(self.page) + 1) <= at:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.beyond[what] = at
        return got

    def closes(self, tag: str, at: int) -> bool:
        """Whether an end tag of this name follows."""
        if tag not in self.last:
            self.last[tag] = self.low.rfind(f"</{tag}")
        return self.last[tag] >= at

    def tag_end(self, at: int) -> int:
        while True:
            at = TO_QUOTE.match(self.page, at).end()
            if at >= len(self.page):
                return len(self.page)
            if self.page[at] == ">":
                return at
            # an equals sign before a quoted value
            at += 1
            while self.page[at].isspace():
                at += 1
            close = self.find(self.page[at], at + 1)
            if close < 0:
                end = self.find(">", at)
                return len(self.page) if end < 0 else end
            at = close + 1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """("text", characters, ""), ("start", tag, attributes) and ("end", tag, "")."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = self.find("<", at)
            if lt != at:
                yield "text", page[at:lt if lt >= 0 else n], ""
                at = lt if lt >= 0 else n
                continue
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), at):
                end = self.find(">", at)
                at = n if end < 0 else end + 1
                continue
            name = NAME.match(page, at)
            if name is None:
                yield "text", "<", ""
                at += 1
                continue
            end, tag = self.tag_end(name.end()), name[1].lower()
            closing, attributes = page[at + 1] == "/", page[name.end():end]
            at = end + 1
            if closing:
                yield "end", tag, ""
            elif tag in RAW:
                if self.closes(tag, at):
                    at = self.low.find(f"</{tag}", at)
                elif tag in ("script", "style"):
                    at = n
            elif end < n:
                yield "start", tag, attributes


def parse(page: str) -> list[Node]:
    """The DOM in page order: block elements, and the text runs between their borders as leaves tagged ``#text``.

    A silent element ends with its own end tag, with that of an element around it, or with a further button or select; without any end
    tag to come, or closed in itself, it holds nothing.
    """
    nodes = [Node("#root", -1, [])]
    stack, run, links = [0], -1, 0
    silent, within = "", Counter()  # the open silent element, and the elements open inside it
    opened: Counter = Counter()  # tags on the stack
    scanner = _Scanner(page)

    def close(depth: int) -> None:
        for i in stack[depth:]:
            opened[nodes[i].tag] -= 1
        del stack[depth:]

    for kind, tag, attributes in scanner:
        if silent:
            if kind == "start":
                if tag == silent and tag in ("button", "select"):
                    within.clear()
                elif not attributes.endswith("/") and tag not in VOID:
                    within[tag] += 1
                continue
            if kind == "text":
                continue
            if within[tag]:
                within[tag] -= 1
                continue
            if tag != silent and not opened[tag]:
                continue
            over, silent = silent, ""
            within.clear()
            if tag == over:
                continue
        if kind == "text":
            if run < 0:
                if not tag.strip():
                    continue
                nodes.append(Node("#text", stack[-1], []))
                run = len(nodes) - 1
            nodes[run].text.append(tag)
            if links:
                nodes[run].linked += len(tag)
            continue
        end = kind == "end"
        if tag == "a":
            links = max(0, links + (-1 if end else 1))
        elif tag in ("br", "wbr"):
            if run >= 0 and tag == "br":
                nodes[run].text.append(" ")
        elif tag in VOID:
            if tag == "hr":
                run = -1
        elif tag in SILENT:
            if not end and not (attributes.endswith("/") and tag in ("svg", "math")) and scanner.closes(tag, 0):
                silent = tag
        elif tag in INLINE or tag in RAW or tag == "head":
            continue
        elif end:
            run, links = -1, 0
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
        else:
            run, links = -1, 0
            if nodes[stack[-1]].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (tag not in ("p",) or nodes[stack[-1]].tag == "p"):
                close(len(stack) - 1)
            elif tag in ENDS:
                ended, stop = ENDS[tag]
                if any(opened[x] for x in ended):
                    for i in range(len(stack) - 1, 0, -1):
                        if nodes[stack[i]].tag in stop:
                            break
                        if nodes[stack[i]].tag in ended:
                            close(i)
                            break
            nodes.append(_element(tag, attributes, stack[-1]))
            opened[tag] += 1
            stack.append(len(nodes) - 1)
    _landmarks(nodes)
    return nodes


def _landmarks(nodes: list[Node]) -> None:
    """Features of the runs, and what the place of a node says: names against what holds the article are void.

    An element holds the article if an article or main element lies in it, or the page's first h1 and half of its unlinked text.
    """
    inside = [0] * len(nodes)  # 1 in article or main, or below a header in it
    weight, heads = [0] * len(nodes), [0] * len(nodes)
    holds = [False] * len(nodes)
    first = True
    for i, node in enumerate(nodes):
        above = inside[node.parent] if node.parent >= 0 else 0
        inside[i] = 1 if above or node.tag in FOR_TAGS else 0
        if node.tag == "#text":
            raw = sum(map(len, node.text))
            _describe(node, nodes[node.parent], raw)
            weight[i] = max(0, raw - node.linked)
        elif node.tag == "h1" and first:
            heads[i], first = 1, False
        elif node.tag in FOR_TAGS:
            holds[i] = True
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        weight[up] += weight[i]
        heads[up] |= heads[i]
        holds[up] |= holds[i]
    for i, node in enumerate(nodes[1:], 1):
        if node.landmark >= 0 or node.prior <= -2 * CERTAIN:
            continue
        wraps = node.tag not in AGAINST_TAGS and (holds[i] or (not holds[0] and heads[i] and 2 * weight[i] > weight[0]))
        if wraps or (node.tag == "header" and inside[i]):
            node.prior, node.landmark = 0.0, 0
    marked = [0] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        above = marked[node.parent]
        marked[i] = -1 if node.landmark < 0 or above < 0 else 1 if node.landmark > 0 or above > 0 else 0
        if above > 0 and marked[i] > 0 and "linked 3" not in node.features:
            node.prior += EVIDENCE


def _describe(run: Node, parent: Node, raw: int) -> None:
    run.text = [" ".join(html.unescape("".join(run.text)).split())]
    text = run.text[0]
    words = text.count(" ") + 1
    run.features = [f"in {parent.tag}", f"words {min(6, int(math.log2(words)))}", f"linked {min(3, 4 * run.linked // max(1, raw))}",
                    f"sentence {text.rstrip(')”“’ ').endswith(('.', '!', '?', '…', ':'))}", f"commas {min(2, text.count(','))}"]


def labels(nodes: list[Node]) -> list[int] | None:
    """1 content, 0 not, for every node of a page whose article is marked; None where nothing marks it."""
    if not any(n.landmark == 1 for n in nodes):
        return None
    out = [0] * len(nodes)
    inside = [0] * len(nodes)
    for i, n in enumerate(nodes):
        above = inside[n.parent] if n.parent >= 0 else 0
        inside[i] = -1 if n.landmark < 0 or above < 0 else 1 if n.landmark > 0 or above > 0 else 0
        out[i] = int(inside[i] > 0)
    for i in range(len(nodes) - 1, 0, -1):  # what holds the article is not against it
        if out[i]:
            out[nodes[i].parent] = 1
    return out


def _kind(n: Node) -> str:
    return "run" if n.tag == "#text" else "element"


@dataclass(frozen=True)
class DomModel:
    """Log odds of features, and log potentials of (kind, parent's label, own label)."""

    odds: dict[str, float]
    edges: dict[tuple[str, int, int], float]


def fit(counts: Counter, edges: Counter, cap: float = 1.5, pseudo: float = 4.0) -> DomModel:
    """Smoothed, capped log odds of each feature and transition probabilities of each kind of edge."""
    total = [sum(v for (f, y), v in counts.items() if y == k) + pseudo for k in (0, 1)]
    odds = {}
    for f in {f for f, _ in counts}:
        a, b = counts[f, 1] + pseudo * total[1] / sum(total), counts[f, 0] + pseudo * total[0] / sum(total)
        limit = 0.2 if f.partition(" ")[2] in NEUTRAL else cap
        odds[f] = max(-limit, min(limit, math.log(a / b) - math.log(total[1] / total[0])))
    table = {}
    for kind in ("run", "element"):
        for up in (0, 1):
            stay = (edges[kind, up, up] + 99.0) / (edges[kind, up, up] + edges[kind, up, 1 - up] + 100.0)
            stay = min(stay, 0.999) if up == 0 else min(stay, 0.97)
            table[kind, up, up], table[kind, up, 1 - up] = math.log(stay), math.log(1 - stay)
    return DomModel(odds, table)


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_pages: int = 1_500) -> DomModel:
    """Learn from the pages that mark their article (article or main elements), at most about ``max_pages``, by hash.

    A page labels itself: what lies in the marked element and not in a menu, form, advert or the like is content. Only
    counts of features reach the driver. Without a labelled page the prior knowledge decides alone.
    """
    pages = pages.where(F.regexp_like(F.col(html_col), F.lit(r"(?i)<(article|main)[\s>]")))
    n = pages.count()
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)).alias("h"))
    if n > max_pages:
        rows = rows.where(F.col("h") < -(1 << 63) + int((1 << 64) * max_pages / n))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in parts:
            for page in pdf["html"]:
                nodes = parse(page or "")
                y = labels(nodes)
                if y is None:
                    continue
                for i, node in enumerate(nodes[1:], 1):
                    c.update((f, y[i], -1) for f in node.features)
                    c[_kind(node), y[node.parent], y[i]] += 1
        yield pd.DataFrame([(f, a, b, n) for (f, a, b), n in c.items()], columns=["f", "a", "b", "n"])

    got = rows.select("html").mapInPandas(count, "f string, a int, b int, n long").groupBy("f", "a", "b").agg(F.sum("n").alias("n"))
    features, edges = Counter(), Counter()
    # features seen in few nodes say little; what is left is bounded by the sample
    for r in got.where("n >= 5").collect():
        if r["b"] < 0:
            features[r["f"], r["a"]] = r["n"]
        else:
            edges[r["f"], r["a"], r["b"]] = r["n"]
    return fit(features, edges)


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: DomModel) -> list[float]:
    """P(content) of every node by one upward and one downward pass of sum-product messages."""
    n = len(nodes)
    own = [[0.0, x.prior + max(-EVIDENCE, min(EVIDENCE, sum(model.odds.get(f, 0.0) for f in x.features)))] for x in nodes]
    own[0] = [0.0, 6.0]
    belief = [list(x) for x in own]
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        e, k = model.edges, _kind(nodes[i])
        m = tuple(_sum(e[k, y, 0] + belief[i][0], e[k, y, 1] + belief[i][1]) for y in (0, 1))
        up[i] = m
        p = belief[nodes[i].parent]
        p[0] += m[0]
        p[1] += m[1]
    out = [0.0] * n
    out[0] = 1 / (1 + math.exp(max(-700, min(700, belief[0][0] - belief[0][1]))))
    for i in range(1, n):
        e, k, p = model.edges, _kind(nodes[i]), belief[nodes[i].parent]
        rest = (p[0] - up[i][0], p[1] - up[i][1])
        down = [_sum(e[k, 0, y] + rest[0], e[k, 1, y] + rest[1]) for y in (0, 1)]
        belief[i] = [belief[i][0] + down[0], belief[i][1] + down[1]]
        out[i] = 1 / (1 + math.exp(max(-700, min(700, belief[i][0] - belief[i][1]))))
    return out


def main_text(page: str | None, model: DomModel) -> str:
    """The content runs of a page, one a line; null, empty and contentless pages give the empty text."""
    nodes = parse(page or "")
    p = marginals(nodes, model)
    return "\n".join(x.text[0] for x, q in zip(nodes, p, strict=True) if x.tag == "#text" and q > 0.5 and x.text[0])


def extract(page: Column, model: DomModel, spark) -> Column:
    """Main text of whole pages; never null, empty for null, empty and contentless pages.

    A column: rows and other columns stay as they are, whatever their names, and an empty table stays empty. A page is parsed alone,
    in time proportional to its length, so repeated rows get equal texts.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(x, shared.value) for x in pages], dtype=object)
    return F.pandas_udf(run, "string")(page)
