"""Main text of web pages by boosted trees over the nodes of the document tree.

A page is parsed into block elements and runs of text.  Every node gets features: its tag, words of its class, id and
role, depth, size and density of its subtree, share of link text, sentence marks, form controls, and the same of its
parent and siblings.  Gradient-boosted trees give each node the log-odds of belonging to the article.  Decoding is
hierarchical: a subtree is kept only if keeping its root and the best choice below it gains more than dropping all of
it, so nothing is kept below a dropped node.

The tables carry no labels.  Training pages come from a bounded sample: where a page has a semantic article, its
marked-up regions are labels, and the same blocks are laid out anew in other page designs (other tags and class names,
sidebars, notices, forms, reader comments), whose labels are known from their making.

Scale: one scan for the sample, one to extract; pages are independent and nothing is shuffled.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import sample_share, slices

#: pages that train the trees, chosen by a hash of the id
SAMPLE_PAGES = 250
#: layouts made of each training page
LAYOUTS = 3
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
#: log-odds that a plain text element inside a marked article goes with it
AGREEMENT = 2.0
PLAIN = frozenset("#text p h1 h2 h3 h4 h5 h6 blockquote pre".split())

# --------------------------------------------------------------------------------------------------------------------
# parsing
# --------------------------------------------------------------------------------------------------------------------

#: fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no markup, and elements that show none of theirs
RAW = frozenset("script style title textarea iframe".split())
ENCLOSED = frozenset("noscript template object svg math select datalist canvas audio video button".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul option optgroup caption").split())
CLOSES_P = BLOCK - frozenset("body head html tbody td tfoot th thead tr option optgroup caption legend summary".split())
#: elements that a new element of the same group ends, and those that bound the search
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"})}
CONTROLS = frozenset("input button select textarea label option".split())
TAGS = ["#text", "div", "p", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li",
        "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "blockquote", "pre", "figure", "dl", "dd", "dt", "body"]
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: words of class, id and role that name parts of a page (fixed value)
PARTS = [
    "nav menu navbar navigation menubar topnav", "header masthead banner topbar branding", "footer foot colophon copyright legal",
    "sidebar side aside widget related complementary rail recommended", "ad ads advert advertisement adsense sponsor sponsored promo promoted",
    "notice cookie cookies consent popup modal alert newsletter subscribe gdpr overlay toast warning",
    "comment comments reply replies discuss discussion disqus respond feedback reader readers", "form search login signup contact register",
    "share social sharing follow", "breadcrumb breadcrumbs pagination pager tags tag meta byline",
    "article content main post entry story body text prose"]
PART_OF = {word: i for i, words in enumerate(PARTS) for word in words.split()}
BOILER_TAGS = frozenset("nav footer aside form menu search dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CONCEALED = re.compile(r"(?:^|\s)hidden(?:\s|=|/|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_LABEL = re.compile(r"data-part\s*=\s*\"([01])\"")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element, or a run of text between block boundaries (tag ``#text``)."""

    __slots__ = ("tag", "parent", "depth", "parts", "concealed", "label", "pieces", "links", "controls", "inline", "children", "above", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.text = tag, parent, ""
        self.depth = parent.depth + 1 if parent else 0
        self.parts, self.concealed, self.label = 0, False, None
        self.pieces, self.links, self.controls, self.inline, self.children = [], 0, 0, 0, []
        if attributes:
            for found in _NAMES.finditer(attributes):
                for word in _WORDS.findall(found[2] or found[3] or found[4] or ""):
                    part = PART_OF.get(word.lower())
                    if part is not None:
                        self.parts |= 1 << part
            self.concealed = _CONCEALED.search(attributes) is not None
            if label := _LABEL.search(attributes):
                self.label = int(label[1])
        self.above = 0
        if parent:
            self.above = parent.above | parent.parts | (1 << len(PARTS) if parent.tag in BOILER_TAGS else 0) \
                | (1 << len(PARTS) + 1 if parent.tag in ("article", "main") else 0)
            self.concealed = self.concealed or parent.concealed
            if self.label is None:
                self.label = parent.label
            parent.children.append(self)


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first; text is decoded and its white space collapsed.

    A tag with an unmatched quote ends at the next ``>``, so that it does not swallow the rest of the page; a tag cut
    off by the end of the page is dropped.
    """
    root = Node("#root", None)
    nodes, stack = [root], [("#root", root)]  # open elements with the block they lie in
    run: Node | None = None
    at, n, links = 0, len(page), 0
    skip = 0  # place in the stack of the outermost element that shows nothing

    def add_text(raw: str) -> None:
        nonlocal run
        if skip:
            return
        if run is None:
            if not raw or raw.isspace():
                return
            run = Node("#text", stack[-1][1])
            nodes.append(run)
        run.pieces.append(raw)
        if links:
            run.links += len(raw)

    def close_to(depth: int) -> None:
        nonlocal run, links, skip
        for tag, _ in stack[depth:skip or None]:
            if tag in BLOCK:
                run = None
            elif tag == "a":
                links -= 1
        del stack[depth:]
        if depth <= skip:
            skip = 0

    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            add_text(page[at:])
            break
        if found.start() > at:
            add_text(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK and not 0 < skip < depth:
                    break  # an inline end tag does not reach out of its block, but ends what shows nothing
            if (tag in BLOCK or tag == "br") and not skip:
                run = None
            continue
        block = stack[-1][1]
        if tag in CONTROLS and not skip:
            block.controls += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not skip:
                run = None
            continue
        # a slash ends elements of drawings and formulas only
        if attributes.rstrip().endswith("/") and (tag in ("svg", "math") or skip and stack[skip][0] in ("svg", "math")):
            continue
        if tag not in BLOCK:
            if not skip and (run is None or tag != "b"):
                block.inline += 1
            if tag == "a" and not skip:
                for depth in range(len(stack) - 1, 0, -1):  # links do not nest
                    if stack[depth][0] == "a":
                        close_to(depth)
                    if stack[depth - 1][0] in BLOCK:
                        break
                links += 1
            stack.append((tag, block))
            # what stands around such an element stays one run of text; it ends with its parent at the latest
            if not skip and (tag in ENCLOSED or attributes and _CONCEALED.search(attributes)):
                links -= tag == "a"
                skip = len(stack) - 1
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in SAME:
            ends, bound = SAME[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in bound:
                    break
                if stack[depth][0] in ends:
                    close_to(depth)
                    break
        if skip:
            stack.append((tag, block))
            continue
        run = None
        node = Node(tag, stack[-1][1], attributes)
        nodes.append(node)
        stack.append((tag, node))
    kept = []
    for node in nodes:
        if node.tag == "#text":
            node.text = " ".join(html.unescape("".join(node.pieces)).split())
            node.pieces = []
            if not node.text:
                node.parent.children.remove(node)
                continue
        kept.append(node)
    return kept


# --------------------------------------------------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------------------------------------------------

_MARKS = re.compile(r"[.,;:!?]")
N_FEATURES = 26 + 2 * len(PARTS) + 2


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    number = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([number[id(x.parent)] if x.parent else -1 for x in nodes])
    own = np.zeros((n, 7))  # characters, words, link characters, sentence marks, text runs, controls, inline elements
    for i, x in enumerate(nodes):
        if x.text:
            own[i, :5] = len(x.text), x.text.count(" ") + 1, min(x.links, len(x.text)), len(_MARKS.findall(x.text)), 1
        own[i, 5], own[i, 6] = x.controls, x.inline
    total, size = own.copy(), np.ones(n)
    items = np.array([float(x.tag in ("li", "td", "dd")) for x in nodes])
    paragraphs = np.array([float(x.tag == "p") for x in nodes])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        size[p] += size[i]
        items[p] += items[i]
        paragraphs[p] += paragraphs[i]
    before = np.cumsum(own[:, 0]) - own[:, 0]
    all_ = max(1.0, total[0, 0])
    place, brothers, left, right, alike = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for x in nodes:
        below = [number[id(c)] for c in x.children]
        tags = [c.tag for c in x.children]
        for k, i in enumerate(below):
            place[i], brothers[i] = k / max(1, len(below) - 1), len(below)
            left[i] = total[below[k - 1], 0] if k else 0.0
            right[i] = total[below[k + 1], 0] if k + 1 < len(below) else 0.0
            alike[i] = tags.count(tags[k]) / len(tags) if len(tags) < 200 else 1.0
    up = np.maximum(parent, 0)
    chars = np.maximum(1.0, total[:, 0])
    tag = np.array([TAG_NUMBER.get(x.tag, len(TAGS)) for x in nodes], float)
    depth = np.array([x.depth for x in nodes], float)
    out = np.column_stack([
        tag, depth, np.log1p(total[:, 0]), np.log1p(total[:, 1]), total[:, 2] / chars, total[:, 3] / np.maximum(1, total[:, 1]),
        np.log1p(size), total[:, 0] / size, total[:, 0] / np.maximum(1, total[:, 4]), items / size, paragraphs / size,
        np.log1p(total[:, 5]), total[:, 6] / size, place, np.log1p(brothers), alike, np.log1p(left), np.log1p(right),
        before / all_, total[:, 0] / all_, tag[up], np.log1p(total[up, 0]), total[up, 2] / chars[up],
        total[up, 0] / size[up], np.array([float(x.concealed) for x in nodes]), np.log1p(total[up, 5])])
    bits = np.array([[x.parts >> k & 1 for k in range(len(PARTS))] + [x.above >> k & 1 for k in range(len(PARTS) + 2)] for x in nodes], float)
    return np.column_stack([out, bits])


# --------------------------------------------------------------------------------------------------------------------
# boosted trees
# --------------------------------------------------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth; a row goes right where its feature exceeds the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, ridge: float = 2.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss with histograms of at most ``BINS`` bins."""
    n, d = x.shape
    cuts = np.full((d, BINS - 1), np.inf)
    binned = np.zeros((n, d), np.int64)
    for j in range(d):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        values = values[values < x[:, j].max()]
        cuts[j, :len(values)] = values
        binned[:, j] = np.searchsorted(values, x[:, j])
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), 2 ** DEPTH - 1
    made = BoostedTrees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            where = (at - first) * BINS
            gain = np.full((width, d), -np.inf)
            split = np.zeros((width, d), np.int64)
            for j in range(d):
                gs = np.bincount(where + binned[:, j], g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(where + binned[:, j], h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                value[~np.isfinite(np.append(cuts[j], np.inf))[None, :].repeat(width, 0)] = -np.inf
                split[:, j] = value.argmax(1)
                gain[:, j] = value.max(1)
            best = gain.argmax(1)
            for k in range(width):
                if gain[k, best[k]] > 1e-6:
                    made.feature[t, first + k] = best[k]
                    made.threshold[t, first + k] = cuts[best[k], split[k, best[k]]]
            node_feature = made.feature[t, at]
            at = 2 * at + 1 + (x[np.arange(n), node_feature] > made.threshold[t, at])
        leaf = at - inner
        made.leaf[t] = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += made.leaf[t][leaf]
    return made


# --------------------------------------------------------------------------------------------------------------------
# training pages
# --------------------------------------------------------------------------------------------------------------------

#: designs (fixed values): how an article, and each kind of other part, may be marked up
ARTICLES = ["<article>|</article>", "<main>|</main>", "<div class=\"content\">|</div>", "<div id=\"main-content\">|</div>",
            "<section class=\"post\">|</section>", "<div class=\"entry-body\"><div>|</div></div>", "<main><article>|</article></main>",
            "<div>|</div>", "<div class=\"story\"><article>|</article></div>", "<td>|</td>"]
OTHERS = {
    "menu": ["<nav><ul>|</ul></nav>", "<div class=\"menu\"><ul>|</ul></div>", "<ul id=\"nav\">|</ul>", "<div class=\"breadcrumbs\"><ul>|</ul></div>",
             "<header><nav><ul>|</ul></nav></header>", "<div><ul>|</ul></div>"],
    "plain": ["<header>|</header>", "<div class=\"site-header\">|</div>", "<footer>|</footer>", "<div id=\"footer\">|</div>", "<aside>|</aside>",
              "<div class=\"sidebar\">|</div>", "<div class=\"ad\">|</div>", "<div class=\"ads-banner\">|</div>", "<section class=\"related\">|</section>",
              "<div class=\"cookie-notice\">|</div>", "<div class=\"notice\">|</div>", "<div role=\"alert\">|</div>", "<div id=\"newsletter\">|</div>",
              "<div class=\"share\">|</div>", "<div class=\"promo\">|</div>", "<div class=\"sponsored\">|</div>", "<div role=\"banner\">|</div>"],
    "form": ["<form>|<input name=\"q\"><button>ok</button></form>", "<div class=\"search\"><form><label>|</label><input></form></div>",
             "<form action=\"/login\"><p>|</p><input><input type=\"submit\"></form>"],
    "comments": ["<section class=\"comments\">|</section>", "<div id=\"comments\">|</div>", "<div class=\"reader-comments\"><h3>Comments</h3>|</div>",
                 "<section id=\"discussion\">|</section>", "<ol class=\"comment-list\">|</ol>"]}


def _wrapped(design: str, inner: str, label: int) -> str:
    return re.sub(r">", f" data-part=\"{label}\">", design, count=1).replace("|", inner, 1)


def layout(blocks: list[str], others: list[str], menu: list[str], rng: random.Random) -> str:
    """A page of another design with the given article blocks; its parts are labelled in ``data-part``."""
    escape = html.escape
    say = lambda: escape(rng.choice(others)) if others else "text"

    def other(kind: str) -> str:
        if kind == "menu":
            inner = "".join(f"<li><a href=\"/\">{escape(x)}</a></li>" for x in rng.sample(menu, min(len(menu), rng.randint(2, 8)))) or "<li><a>x</a></li>"
        elif kind == "comments":
            tag = rng.choice(["p", "div", "li", "article"])
            long_ = lambda: escape(rng.choice(blocks)) if blocks and rng.random() < 0.4 else say()
            inner = "".join(f"<{tag}>{long_()}</{tag}>" for _ in range(rng.randint(1, 6)))
        else:
            texts = [say() for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.2 and blocks:
                texts.append(escape(rng.choice(blocks)))
            inner = "".join(f"<p>{x}</p>" for x in texts) if rng.random() < 0.5 else " ".join(texts)
        return _wrapped(rng.choice(OTHERS[kind]), inner, 0)

    kinds = ["menu", "plain", "plain", "plain", "form", "comments"]
    tags = ["p"] * 8 + ["h2", "blockquote", "div", "li"]
    inner = []
    for i, block in enumerate(blocks):
        tag = "h1" if i == 0 and rng.random() < 0.8 else rng.choice(tags)
        text = escape(block)
        if rng.random() < 0.1 and " " in text:
            head, _, tail = text.partition(" ")
            text = f"<a href=\"/\">{head}</a> {tail}"
        inner.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<header><h1>{text}</h1></header>" if tag == "h1" and rng.random() < 0.2 else f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.25:  # short paragraphs belong to the article as well
            inner.append(f"<p>{escape(' '.join(rng.choice(blocks).split()[:rng.randint(1, 4)]))}</p>")
        if rng.random() < 0.08:
            inner.append(other(rng.choice(["plain", "plain", "form"])))
    article = _wrapped(rng.choice(ARTICLES), "".join(inner) + (other("comments") if rng.random() < 0.25 else ""), 1)
    if article.startswith("<td"):
        article = f"<table><tr>{article}</tr></table>"
    parts = [other(rng.choice(kinds)) for _ in range(rng.randint(1, 4))] + [article] + [other(rng.choice(kinds)) for _ in range(rng.randint(1, 4))]
    body = "".join(parts)
    if rng.random() < 0.5:
        body = f"<div class=\"{rng.choice(['page', 'wrapper', 'container', 'site', 'layout'])}\">{body}</div>"
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labelled(nodes: list[Node], semantic: bool) -> np.ndarray:
    """1 for nodes of the article and those above it, 0 for the rest; by marks, or by semantic elements."""
    inside = {}
    for x in nodes:
        over = inside.get(id(x.parent), False)
        if semantic:
            own = x.tag in ("article", "main") or over
            inside[id(x)] = own and x.tag not in BOILER_TAGS and not x.parts & ((1 << 8) - 1)
        else:
            inside[id(x)] = x.label == 1
    y = np.array([float(inside[id(x)]) for x in nodes])
    number = {id(x): i for i, x in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] and nodes[i].parent is not None:
            y[number[id(nodes[i].parent)]] = 1.0
    return y


def training_rows(pages: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights from pages with a semantic article and layouts made of their blocks."""
    xs, ys, ws = [], [], []

    def add(nodes, semantic, share):
        y, number = labelled(nodes, semantic), {id(x): i for i, x in enumerate(nodes)}
        # decoding asks about a node only below a kept one, so the others count less
        asked = np.array([y[number[id(x.parent)]] if x.parent else 1.0 for x in nodes])
        xs.append(features(nodes)[1:])
        ys.append(y[1:])
        ws.append((share * np.where(asked > 0, 1.0, 0.9) / np.sqrt(len(nodes)))[1:])

    for number, page in enumerate(pages):
        nodes = parse(page or "")
        if not any(x.tag in ("article", "main") for x in nodes):
            continue
        y = labelled(nodes, True)
        blocks = [x.text for x, keep in zip(nodes, y) if x.text and keep]
        others = [x.text for x, keep in zip(nodes, y) if x.text and not keep]
        if not blocks:
            continue
        add(nodes, True, 3.0)
        rng = random.Random(number)
        menu = [x.text for x in nodes if x.text and x.links] or others
        for _ in range(LAYOUTS):
            size = rng.choice([1, 2, 4, len(blocks), len(blocks)])
            add(parse(layout(blocks[:size], others or ["text"], menu or ["text"], rng)), False, 1.0)
    if not xs:
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0)
    return np.vstack(xs), np.concatenate(ys), np.concatenate(ws)


#: pages with a semantic article
_SEMANTIC = r"(?i)<(article|main)[\s>/]"


class Density:
    """Log-odds from text and link density alone, for a table in which no page marks its article."""

    def logit(self, x: np.ndarray) -> np.ndarray:
        own, above = x[:, 26:26 + len(PARTS)], x[:, 26 + len(PARTS):]
        boiler = own[:, :-1].any(1) | above[:, :len(PARTS) - 1].any(1) | (above[:, len(PARTS)] > 0)
        boiler |= np.isin(x[:, 0], [TAG_NUMBER[t] for t in ("nav", "footer", "aside", "form")])
        text, words, linked = x[:, 0] == TAG_NUMBER["#text"], np.expm1(x[:, 3]), x[:, 4]
        in_prose = np.isin(x[:, 20], [TAG_NUMBER[t] for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "td")])
        good = text & (linked < 0.4) & (in_prose | (words >= 8))
        return np.where(boiler, -6.0, np.where(good, 2.0, np.where(text, -2.0, 0.1)))


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BoostedTrees | Density:
    """Train on a sample of the ``html`` that marks its article (by element); without such pages use densities.

    The sample is drawn among all pages of the table that have an article or main element, so a table in which they
    are rare still trains on as many as there are, up to the bound.
    """
    known = pages.where(F.col("html").rlike(_SEMANTIC))
    ids = known.select("page_id", sample_share("page_id", 5).alias("share")).orderBy("share", "page_id").limit(sample_pages)
    n = known.count()
    # the share below which about so many pages lie, so that no text is sorted
    cut = ids.agg({"share": "max"}).first()[0] if n > sample_pages else 1.0
    rows = known.where(sample_share("page_id", 5) <= (1.0 if cut is None else cut)).select("page_id", "html").toPandas() if n else None
    texts = rows.sort_values(["page_id", "html"])["html"].tolist() if n else []
    x, y, weight = training_rows(texts)
    if not len(x) or y.min() == y.max():
        return Density()
    return boost(x, y, weight)


# --------------------------------------------------------------------------------------------------------------------
# decoding
# --------------------------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], logit: np.ndarray) -> list[str]:
    """Kept text runs in page order: the best choice in which nothing is kept below a dropped node."""
    number = {id(x): i for i, x in enumerate(nodes)}
    gain = np.clip(logit, -6.0, 6.0)
    inside = np.array([x.parent is not None and bool((x.above >> len(PARTS) - 1 & 1) | (x.above >> len(PARTS) + 1 & 1)) for x in nodes])
    plain = np.array([x.tag in PLAIN and not x.parts for x in nodes])
    gain[inside & plain] += AGREEMENT
    gain[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].concealed:
            gain[i] = -np.inf
        if gain[i] > 0:
            gain[number[id(nodes[i].parent)]] += gain[i]
    out, kept = [], np.zeros(len(nodes), bool)
    kept[0] = True
    for i, x in enumerate(nodes[1:], 1):
        kept[i] = kept[number[id(x.parent)]] and gain[i] > 0
        if kept[i] and x.text:
            out.append(x.text)
    return out


def extract(pages: DataFrame, model: BoostedTrees | Density) -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by line ends in
    page order.  A null or empty page has the empty text.  Repeated rows come back as often as given, extra columns are
    ignored, an empty table gives no rows, and pages of any length are read whole.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                trees = [parse(p or "") for p in part["html"].to_pylist()]
                logit = held.value.logit(np.vstack([features(t) for t in trees]))
                cuts = np.cumsum([len(t) for t in trees])[:-1]
                texts = ["\n".join(decode(t, one)) for t, one in zip(trees, np.split(logit, cuts))]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Train on a sample of the pages and extract all."""
    return extract(pages, fit(pages, sample_pages))
