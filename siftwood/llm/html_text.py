"""Main text of pages by a tree-structured graphical model over the DOM.

A page's elements form a tree; each has a hidden label, main text or not. The
unary potential of a node is a log-linear function of its tag, the words in its
class, id and role, its text (length, share of the page, link density, marks of
copyright); each parent-child pair has a potential that favours equal labels and
has a price of its own for a part that interrupts main text, by the kinds of the two. Sum-product messages go upward (leaves to root) and downward
and give the marginals: a node's text is kept if its own is over one half, and the
weights are fitted to labelled pages by maximum likelihood with the marginals as
expectations.

Blocks end at block-level tags. In a block, white space becomes one space; blocks
are joined by an empty line, in page order.

Results: null, empty and tagless html give the text of their blocks under the
model (empty text for null and empty); pages of any length and depth are read whole
in time proportional to their length; a tag that never ends is text; unclosed,
crossing and stray tags are taken as browsers do in outline; repeated rows get equal
texts; an empty table gives an empty table; columns that clash with result names are
replaced, all others but html are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table, without, worker_state
from .labelled_pages import BARE, labelled_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is no text of the page up to its end tag; and what is text, but holds no tags.
RAW, PLAIN = frozenset("script style textarea title iframe noembed noframes".split()), frozenset(["xmp"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label math mi mn mo svg text tspan".split())
#: A start tag closes an open tag of these, up to one that holds them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS = frozenset("ul ol dl table article aside div section main nav form td th body html blockquote header footer fieldset details figure".split())
NAME, STOP = re.compile(r"</?([a-zA-Z][^\s/>]*)"), re.compile(r"[\"'>]")
COPYRIGHT = re.compile(r"©|&copy;|&#169;|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of classes, ids and roles, by what they speak for.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager topbar toolbar tabs skip".split(),
    "edge": "header masthead footer footnav colophon copyright contentinfo logo tagline branding imprint".split(),
    "side": "sidebar side aside widget widgets rail complementary related recommended recommendations trending popular teaser teasers tagcloud archives blogroll".split(),
    "notice": "cookie cookies notice notices consent gdpr alert popup modal overlay toast paywall".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion promotions banner adbox adsense commercial affiliate".split(),
    "form": "form searchform login signin signup newsletter subscribe subscription".split(),
    "reader": "comment comments commentlist reply replies respond disqus discussion reader readers thread reactions ugc".split(),
    "share": "share sharing social follow facebook twitter".split(),
    "main": "article content post entry story main body text maincontent page prose markdown".split(),
}
WORD_GROUP = {w: g for g, ws in WORDS.items() for w in ws}
TAG_GROUP = {t: g for g, ts in {"t_menu": "nav menu", "t_edge": "header footer address", "t_side": "aside", "t_form": "form button input select option textarea label fieldset legend datalist", "t_main": "article main", "t_text": "p blockquote pre figcaption dd dt details summary figure noscript template xmp", "t_title": "h1 h2 h3 h4 h5 h6", "t_list": "ul ol li dl table tr td th tbody thead", "t_root": "#root html body head", "t_box": "div section", "t_link": "a"}.items() for t in ts.split()}
FEATURES = ["bias", *sorted(set(TAG_GROUP.values())), "t_inline", *WORDS, "hidden", "links_some", "links_most", "text_none", "text_short", "text_long", "share_most", "share_some", "copyright", "copyright_box", "bare", "with_titles", "with_prose"]
AT = {f: i for i, f in enumerate(FEATURES)}


class Tree:
    """tags, parents (in document order, parents first), attribute strings, and runs: (node, text or None for the end of a block)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str | None]] = []
        self.open: Counter[str] = Counter()
        stack, at, end = [0], 0, len(html)
        never: dict[str, int] = {}  # no such sign stands behind this place

        def find(what: str, start: int) -> int:
            if start >= never.get(what, end + 1):
                return -1
            k = html.find(what, start)
            if k < 0:
                never[what] = start
            return k

        low = None
        while at < end:
            k = find("<", at)
            while 0 <= k and not (html[k + 1 : k + 2].isalpha() and html[k + 1].isascii() or html[k + 1 : k + 2] in ("!", "?") or NAME.match(html, k, k + 3)):
                k = find("<", k + 1)
            stop = k if k >= 0 else end
            if html.startswith(("<!", "<?"), stop):
                comment = html.startswith("<!--", stop)
                close = find("-->", stop + 4) if comment else find(">", stop)
                after = end if close < 0 and comment else close + (3 if comment else 1)
                if close < 0 and not comment:
                    stop = after = end
                name = ""
            elif k >= 0:
                m = NAME.match(html, k)
                name, after = m[1].lower(), self._tag_end(html, m.end(), find)
                if after < 0:
                    stop = after = end
                    name = ""
            else:
                name, after = "", end
            if stop > at:
                self.runs.append((stack[-1], html[at:stop]))
            at = after
            if not name:
                continue
            if html[k + 1] == "/":
                self._close(stack, name)
                continue
            attributes = html[m.end() : after - 1]
            self._make_room(stack, name)
            if name not in INLINE:
                self.runs.append((stack[-1], None))
            elif name == "br":
                self.runs.append((stack[-1], " "))
            ended = attributes.rstrip().endswith("/")
            if name in RAW or name in PLAIN:
                if ended:
                    continue
                if low is None:
                    low = html.lower()
                    low = low if len(low) == end else "".join(c.lower() if c.isascii() else c for c in html)
                close = low.find(f"</{name}", at) if at < never.get(name, end + 1) else -1
                if close < 0:
                    never[name] = at
                if name in PLAIN:
                    self._add(stack, name, attributes)
                    self.runs.append((len(self.tags) - 1, html[at : end if close < 0 else close].replace("&", "&amp;")))
                    self.runs.append((stack[-1], None))
                gt = find(">", close) if close >= 0 else -1
                at = end if gt < 0 else gt + 1
                continue
            if name in VOID:
                continue
            self._add(stack, name, attributes)
            if not ended or name in INLINE or name in CLOSES_P:
                stack.append(len(self.tags) - 1)
                self.open[name] += 1

    def _add(self, stack: list[int], name: str, attributes: str) -> None:
        self.tags.append(name)
        self.parents.append(stack[-1])
        self.attributes.append(attributes)

    @staticmethod
    def _tag_end(html: str, at: int, find) -> int:
        """The place behind a tag's >, which may not stand in quotes; -1 if there is none. A quote that never closes is a sign as others are."""
        if find(">", at) < 0:
            return -1
        plain = -1
        while m := STOP.search(html, at):
            if m[0] == ">":
                return m.end()
            close = find(m[0], m.end())
            if close < 0:
                plain = find(">", m.end()) + 1
                return plain or -1
            at = close + 1
        return -1

    def _pop(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            self.open[self.tags[i]] -= 1
        del stack[k:]

    def _make_room(self, stack: list[int], name: str) -> None:
        if name in CLOSES_P:
            self._drop(stack, ("p",))
        if name in CLOSES:
            self._drop(stack, CLOSES[name])

    def _drop(self, stack: list[int], names: tuple[str, ...]) -> None:
        """Closes the innermost open element of these names, unless something that holds them is further in."""
        if not any(self.open[n] for n in names):
            return
        k = len(stack) - 1
        while k > 0 and self.tags[stack[k]] not in names:
            if self.tags[stack[k]] in HOLDS:
                return
            k -= 1
        if k > 0:
            self.runs.append((stack[k], None))
            self._pop(stack, k)

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        k = len(stack) - 1
        while k > 0 and self.tags[stack[k]] != name:
            if name in INLINE and self.tags[stack[k]] not in INLINE:
                return
            k -= 1
        if k > 0:
            if name not in INLINE:
                self.runs.append((stack[k], None))
            self._pop(stack, k)

    def lengths(self) -> tuple[list[int], list[int]]:
        """Characters of text, and of link text, in each node's subtree."""
        own = [0] * len(self.tags)
        for node, text in self.runs:
            if text is not None:
                own[node] += len(text.strip())
        linked = [n if t == "a" else 0 for n, t in zip(own, self.tags, strict=True)]
        for i in range(len(own) - 1, 0, -1):
            p = self.parents[i]
            own[p] += own[i]
            linked[p] += own[i] if self.tags[i] == "a" else linked[i]
        return own, linked

    def features(self) -> list[list[int]]:
        """The features that each node has."""
        own, linked = self.lengths()
        size = len(self.tags)
        direct, marked = [0] * size, [False] * size
        for node, text in self.runs:
            if text is not None:
                direct[node] += len(text.strip())
                marked[node] = marked[node] or len(text) < 400 and COPYRIGHT.search(text) is not None
        titles, prose = [0] * size, [0] * size
        for i in range(size - 1, 0, -1):  # titles, and long runs of text, in a subtree
            p = self.parents[i]
            titles[p] += titles[i] + (TAG_GROUP.get(self.tags[i]) == "t_title")
            prose[p] += prose[i] + (direct[i] > 140)
            marked[p] = marked[p] or marked[i] and own[p] <= own[i] + 20
        out = []
        for i, (tag, raw, n, k, d) in enumerate(zip(self.tags, self.attributes, own, linked, direct, strict=True)):
            f = [0]
            group = TAG_GROUP.get(tag) or ("t_inline" if tag in INLINE else "")
            if not i and d:
                f.append(AT["bare"])
            elif group:
                f.append(AT[group])
            if raw:
                f += _attribute_features(raw) if len(raw) <= 200 else _attribute_features.__wrapped__(raw)
            if 10 * k > 6 * n:
                f.append(AT["links_most"])
            elif 10 * k > 2 * n:
                f.append(AT["links_some"])
            f.append(AT["text_none" if d == 0 else "text_long" if d > 140 else "text_short"])
            if 2 * n > own[0]:
                f.append(AT["share_most"])
            elif 10 * n > own[0]:
                f.append(AT["share_some"])
            if marked[i]:
                f.append(AT["copyright" if group in ("t_text", "t_title", "t_inline", "t_list") else "copyright_box"])
            if titles[i]:
                f.append(AT["with_titles"])
            if prose[i]:
                f.append(AT["with_prose"])
            out.append(f)
        return out


@lru_cache(maxsize=5_000)
def _attribute_features(raw: str) -> tuple[int, ...]:
    found = set()
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found |= {AT[WORD_GROUP[w.lower()]] for w in PART.findall(value) if w.lower() in WORD_GROUP}
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add(AT["hidden"])
    if len(found) > 1:  # a word of another kind says more than one of "main"
        found.discard(AT["main"])
    return tuple(sorted(found))


BOXES = frozenset("t_menu t_edge t_side t_form t_main t_root t_box".split())
KINDS = 6


def kinds(tree: Tree) -> list[int]:
    """The kind of each node's tie to its parent: whether each of the two is a box, which may begin or end main text, or a part of text; the page as a whole is a kind of box of its own."""
    box = [TAG_GROUP.get(t) in BOXES or t not in TAG_GROUP and t not in INLINE for t in tree.tags]
    root = [TAG_GROUP.get(t) == "t_root" or t == "#root" for t in tree.tags]
    return [3 * box[i] + (2 if root[max(p, 0)] else box[max(p, 0)]) for i, p in enumerate(tree.parents)]


def propagate(parents: list[int], field: list[float], ties: list[float], breaks: list[float]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on a tree: log odds of each node; and of each node and its parent without what they told each other.

    A pair's log potential is its tie for equal labels, the negative tie for others; its break is added where the parent alone is main text."""

    def message(odds: float, equal: float, one: float, other: float) -> float:
        """To a neighbour, log potentials given: equal labels; the sender 0 and the receiver 1; the other way round."""
        x = math.exp(max(-60.0, min(60.0, odds)))
        return math.log((x * math.exp(equal) + math.exp(one)) / (x * math.exp(other) + math.exp(equal)))

    n = len(parents)
    odds, up = list(field), [0.0] * n
    for i in range(n - 1, 0, -1):  # upward: children stand behind their parents
        up[i] = message(odds[i], ties[i], breaks[i] - ties[i], -ties[i])
        odds[parents[i]] += up[i]
    own, above = list(odds), [0.0] * n
    for i in range(1, n):  # downward
        above[i] = odds[parents[i]] - up[i]
        odds[i] += message(above[i], ties[i], -ties[i], breaks[i] - ties[i])
    return odds, own, above


class Forest:
    """Many trees as arrays; levels: the nodes of each depth from 1 on."""

    def __init__(self, trees: list[Tree]):
        parents, depth, x, kind = [], [], [], []
        for tree in trees:
            first, own = len(parents), []
            for p in tree.parents:
                own.append(own[p] + 1 if p >= 0 else 0)
                parents.append(first + p if p >= 0 else -1)
            depth += own
            x += tree.features()
            kind += kinds(tree)
        self.parents, self.kind = np.array(parents), np.array(kind)
        self.levels = [np.flatnonzero(np.array(depth) == d) for d in range(1, max(depth) + 1)]
        self.x = np.zeros((len(x), len(FEATURES)))
        for i, f in enumerate(x):
            self.x[i, f] = 1

    def propagate(self, field: np.ndarray, ties: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """propagate() for all trees at once, level by level."""
        equal, unequal, broken = np.exp(ties), np.exp(-ties), np.exp(breaks - ties)
        odds, up = field.copy(), np.zeros_like(field)
        for at in reversed(self.levels):
            x = np.exp(np.clip(odds[at], -60, 60))
            up[at] = np.log((x * equal[at] + broken[at]) / (x * unequal[at] + equal[at]))
            odds += np.bincount(self.parents[at], up[at], minlength=len(odds))
        own, above = odds.copy(), np.zeros_like(field)
        for at in self.levels:
            above[at] = odds[self.parents[at]] - up[at]
            x = np.exp(np.clip(above[at], -60, 60))
            odds[at] += np.log((x * equal[at] + unequal[at]) / (x * broken[at] + equal[at]))
        return odds, own, above


def page_labels(html: str, tree: Tree) -> list[int]:
    """Labels of the nodes of a labelled page; the page's own text is main text if it begins with the mark."""
    y: list[int] = []
    for raw, p in zip(tree.attributes, tree.parents, strict=True):
        m = re.search(r'data-main="(\d)"', raw)
        y.append(int(m[1]) if m else y[p] if p >= 0 else int(html.startswith(BARE)))
    return y


def fit(pages: list[str], rounds: int = 180) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature weights, ties and breaks that maximise the likelihood of labelled pages, with a ridge; expectations are the marginals of propagate()."""
    trees = [Tree(html) for html in pages]
    forest = Forest(trees)
    labels = np.array([y for html, tree in zip(pages, trees, strict=True) for y in page_labels(html, tree)], np.float64)
    below = np.flatnonzero(forest.parents >= 0)
    child, parent = labels[below], labels[forest.parents[below]]
    kind, of = forest.kind, forest.kind[below]
    x, f = forest.x, len(FEATURES)
    count = lambda v: np.bincount(of, v, minlength=KINDS)
    seen = np.r_[count(2.0 * (child == parent)), count(1.0 * (parent > child))]
    w = np.zeros(f + 2 * KINDS)
    w[f : f + KINDS] = 0.7
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        ties, breaks = w[f : f + KINDS], w[f + KINDS :]
        odds, own, above = forest.propagate(x @ w[:f], ties[kind], breaks[kind])
        a, b = own[below], above[below]
        logs = np.stack([ties[of], a - ties[of], b + breaks[of] - ties[of], a + b + ties[of]])  # neither, the child, the parent, both
        p = np.exp(logs - logs.max(0))
        p /= p.sum(0)
        g = -1e-5 * len(labels) * np.r_[w[:f], np.zeros(KINDS), w[f + KINDS :]]
        g[:f] += x.T @ (labels - 1 / (1 + np.exp(-np.clip(odds, -60, 60))))
        g[f:] += seen - np.r_[count(2 * (p[0] + p[3])), count(p[2])]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g  # Adam
        w = w + 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w[f : f + KINDS] = np.clip(w[f : f + KINDS], 0, 4)
        w[f + KINDS :] = np.clip(w[f + KINDS :], -4, 4)
    return w[:f], w[f : f + KINDS], w[f + KINDS :]


Weights = tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]


@lru_cache(maxsize=1)
def trained() -> Weights:
    """Weights of features, ties and breaks by kind of pair."""
    return tuple(tuple(float(x) for x in part) for part in fit(labelled_pages()))


def accuracy(pages: list[str], weights: Weights) -> tuple[float, float]:
    """Of labelled pages: the share of main text that is found, and of what is found that is main text, by characters."""
    found = right = all_ = 0
    for html in pages:
        tree = Tree(html)
        y, odds = page_labels(html, tree), marginals(tree, weights)
        for node, text in tree.runs:
            n = len("".join((text or "").split()))
            all_ += n * y[node]
            found += n * (odds[node] > 0)
            right += n * (odds[node] > 0) * y[node]
    return right / max(all_, 1), right / max(found, 1)


def marginals(tree: Tree, weights: Weights) -> list[float]:
    """Log odds of main text of each node."""
    by_feature, ties, breaks = weights
    own = kinds(tree)
    return propagate(tree.parents, [sum(by_feature[k] for k in f) for f in tree.features()], [ties[k] for k in own], [breaks[k] for k in own])[0]


def main_text(html: str, weights: Weights) -> str:
    if not html:
        return ""
    tree = Tree(html)
    odds = marginals(tree, weights)
    blocks, held = [], []
    for node, text in [*tree.runs, (0, None)]:
        if text is None:
            if held and (block := " ".join(unescape("".join(held)).split())):
                blocks.append(block)
            held = []
        elif odds[node] > 0:
            held.append(text)
    return "\n\n".join(blocks)


def text_column(html: Column) -> Column:
    weights = trained()

    @F.arrow_udf("string")
    def run(pages):
        import pyarrow as pa

        worker_state("html", dict)
        return pa.array([main_text(p.as_py() or "", weights) for p in pages], pa.string())

    return run(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (main text) and n_chars (its code points), without html."""
    names = ("text", "n_chars")
    out = without(small_batches(pages), *[n for n in names if n != html.lower()])
    (own,) = fresh(out, "main")
    kept = [F.col(f"`{c}`") for c in out.columns if c.lower() not in (html.lower(), *names)]
    out = out.withColumn(own, text_column(F.col(f"`{html}`")))
    return out.select(*kept, F.col(f"`{own}`").alias("text"), F.length(own).cast("long").alias("n_chars"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op3_html_text": op3}
