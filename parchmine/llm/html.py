"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import table

#: Elements that hold no text of a page; elements inside a line; elements without an end tag.
SILENT = set("script style head title noscript template iframe svg object embed canvas audio video map select datalist option button textarea math".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
#: Elements that a head may hold.
HEAD = set("base head link meta noscript script style template title".split())
#: Silent elements whose start tag counts only if an end tag follows: left open, they would silence the rest of the page.
ENDED = SILENT - {"script", "style", "head", "title", "textarea"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag closes, and where the search for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "tbody"}, {"table"}),
    "tbody": ({"thead", "tr", "tbody"}, {"table"}),
    "tfoot": ({"tbody", "tr"}, {"table"}),
    "body": ({"head"}, set()),
}
TAGS = ["nav", "header", "footer", "aside", "form", "article main", "section", "div", "p", "ul ol menu dl", "li dt dd", "h1", "h2 h3 h4 h5 h6", "table thead tbody tfoot tr td th caption", "blockquote pre", "figure figcaption", "dialog", "body html"]
#: Words in class, id, role and label attributes, by what they speak for.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs toolbar sitemap",
    "head": "header head masthead banner topbar logo branding site title tagline",
    "foot": "footer foot copyright bottom colophon legal credits",
    "side": "sidebar side aside rail widget widgets complementary secondary blogroll archive recent popular tags tagcloud",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner-ad dfp outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner subscribe newsletter paywall announcement warning signup privacy",
    "comment": "comment comments commentlist reply replies respond disqus discussion thread reader responses",
    "share": "share sharing social facebook twitter related recommended recommendations more also next prev read",
    "form": "form search login signin register contact input searchbox field",
    "text": "article content post entry main body text story page hentry blog articlebody prose paragraph document",
}
_END = re.compile(r"</([a-zA-Z]+)")
_GROUPS = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}
_TAG = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
NUMBERS = 27


class Node:
    __slots__ = ("tag", "groups", "parent", "children", "order", "depth", "label", "stats")

    def __init__(self, tag, groups, parent, order, label=None):
        self.tag, self.groups, self.parent, self.children, self.order, self.label = tag, groups, parent, [], order, label
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


class Dom(HTMLParser):
    """Block elements of a page in order, and its lines: the runs of text between block boundaries.

    A head ends at the first element or text that may not be in it, whether its end tag is there or not. A noscript,
    button, video or other element of ENDED that is never closed, self-closed ones included, is passed over, and what
    follows it is text of the page.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", frozenset(), None, 0)]
        self.lines: list[tuple[Node, str, int]] = []  # node, text, characters in links
        self.open: list[tuple[str, Node | None]] = [("html", self.nodes[0])]
        self.silent = self.links = self.linked = 0
        self.text: list[str] = []
        self.ends = Counter(t for t in map(str.lower, _END.findall(html)) if t in ENDED)  # that are still to come
        self.feed(html)
        self.close()
        self.cut()

    @property
    def here(self) -> Node:
        return next(n for _, n in reversed(self.open) if n)

    def cut(self) -> None:
        if self.text and (line := " ".join("".join(self.text).split())):
            self.lines.append((self.here, line, self.linked))
        self.text, self.linked = [], 0

    def pop(self, to: int) -> None:
        if any(n for _, n in self.open[to:]):
            self.cut()
        for tag, _ in self.open[to:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[to:]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if self.open[-1][0] == "head" and tag not in HEAD:
            self.pop(len(self.open) - 1)
        if tag in ENDED and self.ends[tag] <= sum(t == tag for t, _ in self.open if self.silent):
            return
        if tag in VOID:
            if tag in INLINE:
                self.text.append(" " if tag == "br" else "")
            else:
                self.cut()
            return
        if tag in SILENT or tag in INLINE:
            self.open.append((tag, None))
            self.silent += tag in SILENT
            self.links += tag == "a"
            return
        names, stops = CLOSES.get(tag, (set(), set()))
        closes = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t in stops:
                break
            if t in names:
                closes = i
            if t == "p" and not self.silent:  # a block ends an open paragraph
                closes = i
                break
            if not names and t not in INLINE:
                break
        self.pop(closes)
        self.cut()
        words, label = set(), None
        for k, v in attrs:
            if k in ("class", "id", "role", "aria-label", "itemprop") and v:
                words.update(v.lower().replace("_", "-").split())
            elif k == "data-truth":
                label = int(v)
        words |= {p for w in words for p in w.split("-")}
        node = Node(tag, frozenset(_GROUPS[w] for w in words if w in _GROUPS), self.here, len(self.nodes), label)
        self.nodes.append(node)
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "math", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ENDED:
            self.ends[tag] -= 1
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if tag in INLINE and self.open[i][1]:  # an inline end tag ends nothing outside its block
                return

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self.pop(len(self.open) - 1)
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def unknown_decl(self, data):
        pass


def node_features(dom: Dom) -> np.ndarray:
    """A row of features for each node: sizes and densities of its subtree, place, siblings, tag and attribute words."""
    nodes = dom.nodes
    n = len(nodes)
    # characters, linked characters, words, lines, full stops and commas, digits, own characters
    s = np.zeros((n, 7))
    start = np.full(n, -1.0)
    total = 0
    for node, line, linked in dom.lines:
        i, size = node.order, len(line)
        marks = line.count(".") + line.count(",") + line.count("!") + line.count("?")
        s[i] += (size, min(linked, size), line.count(" ") + 1, 1, marks, "©" in line or "(c)" in line, size)
        while node and start[node.order] < 0:
            start[node.order] = total
            node = node.parent
        total += size
    subtree = np.ones(n)
    paragraphs, headings, lists, main, first = (np.zeros(n) for _ in range(5))
    for i, x in enumerate(nodes):
        paragraphs[i], headings[i], lists[i] = x.tag == "p", x.tag in ("h2", "h3", "h4"), x.tag == "li"
        main[i], first[i] = x.tag in ("article", "main"), x.tag == "h1"
    below = np.column_stack([s[:, :6], subtree, paragraphs, headings, lists, main, first])
    for i in range(n - 1, 0, -1):  # children come after their parents
        below[nodes[i].parent.order] += below[i]
    place, alike = np.zeros(n, int), np.ones(n, int)
    for x in nodes:
        tags = Counter(c.tag for c in x.children)
        for at, c in enumerate(x.children):
            place[c.order], alike[c.order] = at, tags[c.tag]
    out = np.zeros((n, NUMBERS + len(TAGS) + 3 * len(TOKENS)))
    inside = np.zeros((n, 2), bool)
    above = [frozenset()] * n
    for i, x in enumerate(nodes):
        chars, linked, words, lines, marks, copyright, size, ps, hs, ls, has_main, has_h1 = below[i]
        p = x.parent
        row = out[i]
        if p:
            same, at = alike[i], place[i]
            family = below[p.order, 0]
            up = p.order
            inside[i] = inside[up] | (p.tag in ("article", "main"), p.tag in ("nav", "footer", "aside", "form", "header"))
            above[i] = above[up] | p.groups
            k, sizes = len(p.children), family / len(p.children)
            before = below[p.children[at - 1].order, 0] if at else 0
            after = below[p.children[at + 1].order, 0] if at + 1 < k else 0
        else:
            same, at, family, k, sizes, before, after = 1, 0, chars, 1, chars, 0, 0
        row[:NUMBERS] = (
            x.depth, np.log1p(size), np.log1p(chars), np.log1p(s[i, 6]), linked / max(chars, 1), chars / size, words / size, chars / max(total, 1), marks / max(words, 1),
            words / max(lines, 1), np.log1p(ps), np.log1p(hs), np.log1p(ls), has_main, has_h1, at, at / max(k - 1, 1), k, same / k,
            chars / max(family, 1), np.log1p(sizes), np.log1p(before), np.log1p(after), max(start[i], 0) / max(total, 1), copyright > 0, inside[i, 0], inside[i, 1],
        )
        if x.tag in _TAG:
            row[NUMBERS + _TAG[x.tag]] = 1
        for g in x.groups:
            row[NUMBERS + len(TAGS) + g] = 1
        for g in above[i]:
            row[NUMBERS + len(TAGS) + len(TOKENS) + g] = 1
        for g in p.groups if p else ():
            row[NUMBERS + len(TAGS) + 2 * len(TOKENS) + g] = 1
    return out


class Boosted:
    """Gradient-boosted regression trees of one depth for the logistic loss, on histograms of quantile bins."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        n, f = b.shape
        offset = b + np.arange(f) * self.bins
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(n, self.bias)
        self.splits, self.values = [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            leaf, splits = np.zeros(n, int), []
            for level in range(self.depth):
                wide = 1 << level
                key = (leaf[:, None] * (f * self.bins) + offset).ravel()
                hist = [np.bincount(key, np.repeat(v, f), wide * f * self.bins).reshape(wide, f, self.bins).cumsum(2) for v in (g, h)]
                gl, hl = hist
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(wide, -1).argmax(1)
                feature, cut = best // self.bins, best % self.bins
                splits.append((feature, cut))
                leaf = 2 * leaf + (b[np.arange(n), feature[leaf]] > cut[leaf])
            value = -self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            self.splits.append(splits)
            self.values.append(value)
            z = z + value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        z = np.full(len(x), self.bias)
        for splits, value in zip(self.splits, self.values):
            leaf = np.zeros(len(x), int)
            for feature, cut in splits:
                leaf = 2 * leaf + (b[rows, feature[leaf]] > cut[leaf])
            z += value[leaf]
        return z


def decode(dom: Dom, logits: np.ndarray) -> list[bool]:
    """The likeliest choice of kept nodes in which no kept node has a dropped ancestor; the root is kept."""
    nodes, best = dom.nodes, np.array(logits, float)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent.order] += best[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = bool(keep[nodes[i].parent.order] and best[i] > 0)
    return keep


def main_texts(htmls: list[str | None], model: Boosted) -> list[str]:
    """Kept lines of each page, joined by line feeds; line breaks inside a block are white space."""
    out = []
    for at in range(0, len(htmls), 128):  # nodes of many pages are scored at once
        doms = [Dom(h or "") for h in htmls[at : at + 128]]
        x = [node_features(d) if d.lines else np.zeros((0, NUMBERS + len(TAGS) + 3 * len(TOKENS))) for d in doms]
        logits = np.split(model.logit(np.concatenate(x)), np.cumsum([len(r) for r in x])[:-1])
        for dom, z in zip(doms, logits):
            keep = decode(dom, z) if dom.lines else []
            out.append("\n".join(line for node, line, _ in dom.lines if keep[node.order]))
    return out


def main_text(html: str | None, model: Boosted) -> str:
    return main_texts([html], model)[0]


class Pages:
    """Labelled pages to learn from: made from parts of many layouts, with the truth of each node in data-truth."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(p) for p in ("bcdfghjklmnprstvw", "aeiou", ["", "n", "r", "s", "t", "l"])) for _ in range(40)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(self.syllables) for _ in range(r.choice([1, 1, 2, 2, 3]))) for _ in range(r.randint(low, high))]
        marks = [w + (r.choice([".", ",", ".", ", ", "!"]) if r.random() < 0.12 else "") for w in out]
        return escape(" ".join(marks)).capitalize()

    def tag(self, name: str, truth: int, inner: str, names: str = "", chance: float = 0.75) -> str:
        attr, chance = "", min(chance, 0.5) if name in ("nav", "header", "footer", "aside", "form") else chance
        if names and self.r.random() < chance:
            attr = f' {self.r.choice(["class", "id", "class"])}="{self.r.choice(names.split())}"'
        end = "" if name == "p" and self.r.random() < 0.1 else f"</{name}>"
        return f'<{name}{attr} data-truth="{truth}">{inner}{end}'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int, truth: int = 0) -> str:
        if self.r.random() < 0.7:
            return self.tag("ul", truth, "".join(self.tag("li", truth, self.link()) for _ in range(self.r.randint(low, high))))
        return self.r.choice([" ", " | ", ""]).join(self.link() for _ in range(self.r.randint(low, high)))

    def menu(self) -> str:
        if self.r.random() < 0.15:
            return self.tag("ul", 0, "".join(self.tag("li", 0, self.link()) for _ in range(self.r.randint(3, 10))), "menu nav breadcrumbs", 0.8)
        return self.tag(*self.r.choice([("nav", 0), ("nav", 0), ("div", 0)]), self.links(3, 12), "nav menu navbar main-menu breadcrumb", 0.6)

    def head(self) -> str:
        inner = self.r.choice([self.tag("div", 0, self.words(1, 4), "logo site-title branding"), self.tag("p", 0, self.words(2, 9), "tagline"), self.tag("h2", 0, self.link()), self.tag("h1", 0, self.words(1, 4)), self.tag("h1", 0, self.link())])
        return self.tag(*self.r.choice([("header", 0), ("header", 0), ("div", 0)]), inner + (self.menu() if self.r.random() < 0.6 else ""), "header masthead site-header topbar", 0.9)

    def foot(self) -> str:
        inner = self.r.choice(["&copy; " + self.words(2, 14), self.tag("p", 0, self.words(3, 25)), self.links(2, 8), self.words(3, 20) + " " + self.link()])
        return self.tag(*self.r.choice([("footer", 0), ("footer", 0), ("div", 0)]), inner, "footer site-footer copyright bottom", 0.95)

    def side(self) -> str:
        inner = "".join(self.r.choice([self.tag("h3", 0, self.words(1, 3)) + self.links(2, 8), self.tag("p", 0, self.words(4, 30)), self.tag("div", 0, self.words(3, 12), "widget")]) for _ in range(self.r.randint(1, 4)))
        return self.tag(*self.r.choice([("aside", 0), ("aside", 0), ("div", 0)]), inner, "sidebar side widget-area rail secondary", 0.95)

    def ad(self) -> str:
        inner = self.r.choice([self.words(2, 25), self.tag("p", 0, self.words(2, 25)), self.link(2, 9), self.words(3, 12) + self.link()])
        kind = self.r.choice(["div", "div", "section", "aside", "p", "ins"])
        if kind in ("p", "ins"):
            kind, inner = kind.replace("ins", "div"), self.words(2, 25)
        return self.tag(kind, 0, inner, "ad ads advert advertisement sponsored promo ad-slot", 1)

    def notice(self) -> str:
        inner = self.r.choice([self.words(4, 30), self.tag("p", 0, self.words(4, 30))]) + self.r.choice(["", self.link(), "<button>ok</button>"])
        kind = self.r.choice(["div", "div", "section", "dialog", "aside", "p"])
        if kind == "p":
            inner = self.words(4, 30)
        return self.tag(kind, 0, inner, "cookie-notice cookie-banner consent notice alert popup newsletter subscribe gdpr announcement", 1)

    def form(self) -> str:
        inner = self.r.choice(["", self.words(1, 6), self.tag("p", 0, self.words(2, 12)), f"<label>{self.words(1, 3)}</label>"]) + "<input name=q><button>go</button>"
        return self.tag("form", 0, inner, "search login contact newsletter comment-form", 0.6)

    def comments(self) -> str:
        kind = self.r.choice(["div", "li", "article", "p"])
        one = lambda: self.tag(kind, 0, self.words(3, 40) if kind == "p" else self.r.choice([self.tag("p", 0, self.words(3, 60)), self.words(3, 40)]), "comment reply", 0.8)
        inner = self.r.choice(["", self.tag("h3", 0, self.words(1, 3))]) + "".join(one() for _ in range(self.r.randint(1, 7)))
        if kind == "li":
            inner = self.tag(self.r.choice(["ol", "ul"]), 0, inner, "commentlist comments", 0.8)
            if self.r.random() < 0.3:
                return self.tag("div", 0, inner, "comments", 0.9)
        return self.tag(self.r.choice(["section", "div", "div"]), 0, inner + (self.form() if self.r.random() < 0.4 else ""), "comments comment-list responses discussion respond", 1)

    def share(self) -> str:
        return self.tag(self.r.choice(["div", "ul", "section"]), 0, self.r.choice([self.links(2, 6), self.tag("h3", 0, self.words(1, 2)) + self.links(2, 6)]), "share social related recommended", 0.95)

    def paragraph(self) -> str:
        words, r = self.words(*self.r.choice([(2, 12), (10, 60), (40, 160), (40, 160)])), self.r
        if r.random() < 0.2:
            words = f"<b>{words}<br>" if r.random() < 0.4 else f"<em>{words}</em> {self.link()} {self.words(4, 30)}"
        if r.random() < 0.08:
            words = " | ".join(self.words(1, 1) for _ in range(r.randint(4, 80)))
        return self.tag("p", 1, words, "text paragraph", 0.05)

    def article(self) -> str:
        r, title = self.r, self.tag("h1", 1, self.words(2, 14), "title entry-title", 0.2)
        parts = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 25])):
            parts.append(self.paragraph())
            if r.random() < 0.1:
                parts.append(self.tag("h2", 1, self.words(1, 7)))
            if r.random() < 0.06:
                parts.append(self.tag(*r.choice([("ul", 1), ("ol", 1)]), "".join(self.tag("li", 1, self.words(2, 30)) for _ in range(r.randint(2, 7)))))
            if r.random() < 0.04:
                parts.append(self.tag("blockquote", 1, r.choice([self.words(5, 50), self.tag("p", 1, self.words(5, 50))])))
            if r.random() < 0.03:
                row = lambda: self.tag("tr", 1, "".join(self.tag("td", 1, self.words(1, 4)) for _ in range(3)))
                parts.append(self.tag("table", 1, "".join(row() for _ in range(r.randint(2, 6)))))
            if r.random() < 0.04:
                parts.append(self.tag("figure", 1, "<img src=x>" + self.tag("figcaption", 1, self.words(3, 15))))
            if r.random() < 0.1:
                parts.append(r.choice([self.ad, self.share, self.notice, self.form, self.side])())
        if r.random() < 0.15:
            title = self.tag("header", 1, title + r.choice(["", self.tag("p", 1, self.words(2, 6))]))
        body = title * (r.random() < 0.9) + "".join(parts)
        if r.random() < 0.25:
            body = self.tag("div", 1, body, "content body text inner")
        if r.random() < 0.25:
            body += r.choice([self.share, self.comments, self.comments])()
        if r.random() < 0.12:
            return body
        return self.tag(*r.choice([("article", 1), ("article", 1), ("main", 1), ("div", 1), ("section", 1)]), body, "article content post entry story main", 0.5)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.06:
            return f'<html><body data-truth="1">{self.article()}</body></html>'
        if r.random() < 0.04:
            return "".join(self.paragraph() for _ in range(r.choice([1, 1, 2, 4])))
        before = [f() for f, p in ((self.head, 0.5), (self.menu, 0.6), (self.notice, 0.25), (self.ad, 0.4), (self.form, 0.15), (self.side, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0.3), (self.share, 0.2), (self.side, 0.3), (self.ad, 0.2), (self.form, 0.15), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.3:
            inner = self.tag("div", 1, inner, "wrapper container page site")
        return f'<html><head><title>{self.words(2, 8)}</title></head><body data-truth="1">{inner}{self.foot() if r.random() < 0.85 else ""}</body></html>'


@lru_cache(4)
def trained(pages: int = 700, seed: int = 5) -> Boosted:
    """The model, fitted on so many made pages; the same for the same arguments."""
    maker = Pages(seed)
    doms = [Dom(maker.page()) for _ in range(pages)]
    x = np.concatenate([node_features(d)[1:] for d in doms])
    y = np.array([n.label for d in doms for n in d.nodes[1:]], float)
    return Boosted().fit(x, y)


def extract_main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html, ...).

    Null, empty and textless pages have an empty text. Pages are read whole and apart from each other, so repeated
    rows get equal texts. Null ids and urls stay. Columns by other names aren't read and don't return.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # 50 trees of 16 leaves

    @pandas_udf(StringType())
    def texts(htmls: pd.Series) -> pd.Series:
        return pd.Series(main_texts(list(htmls), shared.value), dtype="object")

    out = pages.select("page_id", "url", texts("html").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_main_text() of all pages, with the model that trained() fits."""
    return extract_main_text(table(spark, sf_dir, "pages"))
