"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements; each has features of its subtree, its attribute words, its depth and its siblings.
Boosted trees give every element a probability of being content. Decoding is hierarchical: the most likely choice in
which nothing below a dropped element is kept. The trees are learned here, from pages that a fixed generator writes.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul caption button textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"table", "td", "th", "button", "caption", "object"}}
#: Words of attributes by what they speak for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination topbar skip",
    "head": "header masthead banner logo site top branding hero",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar side aside related widget recommended popular more recent trending secondary complementary tags",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay message warning subscribe paywall",
    "ad": "ad ads advert adverts advertisement promo sponsor sponsored adsense banner-ad outbrain taboola commercial",
    "form": "form search login signup newsletter subscribe register input contact",
    "comment": "comment comments reply replies respond discussion disqus feedback reviews thread",
    "share": "share social sharing follow buttons twitter facebook print",
    "content": "article content main post entry story body text page copy news blog maincontent articlebody",
}
KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "a", "span", "table", "td", "figure", "blockquote", "pre", "button", "body")
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset("script style head title noscript template iframe svg textarea select option button input object noembed noframes xmp".split())

# a quote that nothing closes ends with its tag
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|[\"'][^>]*+(?:>|\Z))", re.S)
_END = {name: re.compile(rf"</{name}(?![0-9a-z])[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HINT_OF = {w: k for k, (_, words) in enumerate(HINTS.items()) for w in words.split()}
#: Elements that speak for the same as words of attributes do.
_HINT_OF_TAG = {t: 1 << list(HINTS).index(h) for t, h in (("nav", "menu"), ("header", "head"), ("footer", "foot"), ("aside", "side"), ("form", "form"), ("article", "content"), ("main", "content"))}
_KIND_OF = {t: k for k, t in enumerate(KINDS)}


class Page:
    """Elements in document order: parent, tag, hints; pieces of text with their element; places where blocks end."""

    def __init__(self, source: str):
        self.tag, self.parent, self.hints = ["html"], [-1], [0]
        self.pieces: list[tuple[int, str | None]] = []  # None is the border of a block
        stack = [0]
        # where elements of a name are on the stack, and those that a new block doesn't close a paragraph across
        places: dict[str, list[int]] = {"html": [0]}
        walls: list[int] = []
        at, size = 0, len(source)

        def close(k: int) -> None:
            """Take the elements from place k on off the stack."""
            border = False
            for i in reversed(stack[k:]):
                name = self.tag[i]
                border = border or name in BLOCK
                if walls and walls[-1] == places[name][-1]:
                    walls.pop()
                places[name].pop()
            if border:
                self.pieces.append((stack[k - 1], None))
            del stack[k:]

        def last(names) -> int:
            """The highest place of an element of these names; 0 if there is none."""
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        while at < size:
            found = _TOKEN.search(source, at)
            end = found.start() if found else size
            if end > at:
                self.pieces.append((stack[-1], source[at:end]))
            if not found:
                break
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                k = last((name,))
                if k and last(HOLDS.get(name, ())) <= k:
                    close(k)
                continue
            if name in ("html", "body") and places.get(name):
                continue
            if name == "body" and len(stack) > 1:
                close(1)
            if name in CLOSES:
                ending, wall = CLOSES[name], last(HOLDS.get(name, ()))
            else:
                ending, wall = {"p"} if name in CLOSES_P else (), walls[-1] if walls else 0
            within = [held[bisect_right(held, wall)] for n in ending if (held := places.get(n)) and held[-1] > wall]
            if within:
                close(min(within))
            node = len(self.tag)
            hints = _HINT_OF_TAG.get(name, 0)
            for a, b, c in _ATTR.findall(found[3]):
                for word in _SPLIT.split(_CAMEL.sub(" ", a or b or c).lower()):
                    if (hint := _HINT_OF.get(word)) is not None:
                        hints |= 1 << hint
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.hints.append(hints)
            if name in BLOCK:
                self.pieces.append((stack[-1], None))
            if name in VOID or found[3].endswith("/") and name in RAW:
                if name == "br":
                    self.pieces.append((stack[-1], " "))
            elif name in RAW:
                shut = _END[name].search(source, at)
                at = shut.end() if shut else size
            else:
                places.setdefault(name, []).append(len(stack))
                if name != "p" and (name in BLOCK or name in HOLDS["p"]):
                    walls.append(len(stack))
                stack.append(node)


FEATURE_COUNT = 18 + len(HINTS) * 2 + len(KINDS) + 2


def features(page: Page) -> np.ndarray:
    """One row for each element."""
    n = len(page.tag)
    own, marks = [0] * n, [0] * n
    for node, text in page.pieces:
        if text and not text.isspace():
            own[node] += len(text)
            marks[node] += text.count(".") + text.count(",")
    length, links, below, stops, paragraphs, depth = own[:], [0] * n, [1] * n, marks[:], [0] * n, [0] * n
    children, place, items, under = [0] * n, [0] * n, [0] * n, page.hints[:]
    tag, parent = page.tag, page.parent
    for i in range(1, n):
        up = parent[i]
        depth[i] = depth[up] + 1
        place[i] = children[up]
        children[up] += 1
        under[i] |= under[up]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if tag[i] == "a":
            links[i] = length[i]
        paragraphs[i] += tag[i] == "p"
        items[i] += tag[i] == "li"
        length[up] += length[i]
        links[up] += links[i]
        below[up] += below[i]
        stops[up] += stops[i]
        paragraphs[up] += paragraphs[i]
        items[up] += items[i]
    up = np.array([0, *parent[1:]])
    L, K, B, S, P, I, D, C, O, own_ = (np.array(x, np.float64) for x in (length, links, below, stops, paragraphs, items, depth, children, place, own))
    hints, around = np.array(page.hints), np.array(under)
    bit = np.arange(len(HINTS))
    kind = np.array([_KIND_OF.get(t, -1) for t in tag])
    whole = max(L[0], 1)
    columns = [
        np.log1p(L), L / whole, L / np.maximum(L[up], 1), np.log1p(L / B), np.log1p(B), K / np.maximum(L, 1), S / np.maximum(L, 1) * 100, np.log1p(P), np.log1p(I), D, C, O, C[up], O / np.maximum(C[up] - 1, 1),
        np.log1p(own_), K[up] / np.maximum(L[up], 1), np.log1p(L[up] / B[up]), np.arange(n) / n,
    ]
    return np.column_stack([*columns, hints[:, None] >> bit & 1, around[:, None] >> bit & 1, kind[:, None] == np.arange(len(KINDS)), [t in HEADS for t in tag], [t in DROPPED for t in tag]]).astype(np.float64)


class Boosted:
    """Boosted trees of full depth on binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24):
        self.depth = depth
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
        n, k = code.shape
        width = bins + 1
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.base)
        flat = code + np.arange(k) * width
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                size = 2**level
                at = (node[:, None] * (k * width) + flat).ravel()
                g = np.bincount(at, np.repeat(gradient, k), size * k * width).reshape(size, k, width).cumsum(2)
                h = np.bincount(at, np.repeat(weight, k), size * k * width).reshape(size, k, width).cumsum(2)
                gain = g**2 / (h + 1) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + 1)
                best = gain[..., :-1].reshape(size, -1).argmax(1)
                f, b = best // (width - 1), best % (width - 1)
                for m in range(size):
                    feature[size - 1 + m] = f[m]
                    cut[size - 1 + m] = cuts[f[m]][b[m]] if b[m] < len(cuts[f[m]]) else np.inf
                node = node * 2 + (code[np.arange(n), f[node]] > b[node])
            leaf = rate * np.bincount(node, gradient, 2**depth) / (np.bincount(node, weight, 2**depth) + 1)
            score += leaf[node]
            self.trees.append((feature, cut, leaf))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of content."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            total += leaf[node]
        return total


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The most likely choice in which no element below a dropped one is kept."""
    n = len(parent)
    keep, drop = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += keep[i] if keep[i] >= drop[i] else drop[i]
        drop[parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] >= drop[i]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of kept elements: white space in a block is one space, blocks are lines."""
    blocks, now = [], []
    for node, text in page.pieces:
        if text is None:
            if now:
                blocks.append(" ".join(html.unescape("".join(now)).split()))
                now = []
        elif kept[node] and page.tag[node] not in DROPPED:
            now.append(text)
    if now:
        blocks.append(" ".join(html.unescape("".join(now)).split()))
    return "\n".join(b for b in blocks if b)


def _generated(draw: random.Random) -> tuple[str, set[int]]:
    """A page, and the numbers of the elements that are dropped with all below (by order of their start tags)."""
    out: list[str] = []
    dropped: set[int] = set()
    number = [0]

    def start(tag: str, attributes: str = "", drop: bool = False) -> None:
        number[0] += tag != "html"
        if drop:
            dropped.add(number[0])
        out.append(f"<{tag}{' ' + attributes if attributes else ''}>")

    def end(tag: str) -> None:
        out.append(f"</{tag}>")

    def words(low: int, high: int, stops: bool = True) -> str:
        some = ["".join(draw.choice("aeiourtnslhdéü") for _ in range(draw.randint(1, 11))) for _ in range(draw.randint(low, high))]
        text = " ".join(w + ("" if not stops or draw.random() > 0.12 else draw.choice(".,")) for w in some).capitalize()
        return text + "." * stops + (" &amp; " + some[0] if draw.random() < 0.1 else "")

    def named(hint: str, p: float = 0.8) -> str:
        word = draw.choice(HINTS[hint].split())
        return f'{draw.choice(("class", "id", "class", "role"))}="{draw.choice(("", "", "site-", "block ", "l-"))}{word}{draw.choice(("", "", "-wrap", " box", "-inner"))}"' if draw.random() < p else ""

    def link_list(low: int, high: int) -> None:
        start("ul")
        for _ in range(draw.randint(low, high)):
            start("li")
            start("a", f'href="/{words(1, 1, False)}"')
            out.append(words(1, 3, False))
            end("a")
            end("li")
        end("ul")

    short = draw.choice((0.05, 0.1, 0.3, 0.9))

    def paragraph() -> None:
        start("p", 'class="text"' if draw.random() < 0.1 else "")
        style = draw.random()
        if style < 0.2:
            start("b")
        out.append(words(1, 3) if draw.random() < short else words(4, 90))
        if 0.2 < style < 0.3:
            start("a", 'href="#x"')
            out.append(words(1, 3, False))
            end("a")
            out.append(" " + words(3, 20))
        while draw.random() < 0.3:
            start(draw.choice(("b", "strong", "em", "i", "span", "code", "u", "mark")))
            inline = out[-1].strip("<>")
            out.append(words(1, draw.choice((1, 2, 8)), False))
            end(inline)
            if draw.random() < 0.8:
                out.append(" " + words(1, draw.choice((2, 20))))
        if draw.random() < 0.2:
            number[0] += 1
            out.append("<br>")
        if draw.random() < 0.8:
            end("p")

    def filled(tag: str, low: int, high: int, stops: bool = False) -> None:
        start(tag)
        out.append(words(low, high, stops))
        end(tag)

    def linked(low: int, high: int) -> None:
        start("a", f'href="https://{words(1, 1, False)}"')
        out.append(words(low, high, False))
        end("a")

    def listing(deep: int = 0) -> None:
        """A list of content: its items are long or short, some are links or hold another list."""
        tag, long = draw.choice(("ul", "ol")), draw.random() < 0.5
        start(tag)
        for _ in range(draw.randint(1, 6)):
            start("li")
            if draw.random() < 0.15:
                linked(1, 6)
            else:
                out.append(words(3, 20) if long else words(1, 4, False))
            if deep < 2 and draw.random() < 0.08:
                listing(deep + 1)
            if draw.random() < 0.8:
                end("li")
        end(tag)

    def figure() -> None:
        start("figure")
        number[0] += 1
        out.append('<img src="x.png" alt="x">')
        if draw.random() < 0.8:
            filled("figcaption", 2, 14, draw.random() < 0.5)
        end("figure")

    def code() -> None:
        start("pre")
        inner = draw.random() < 0.5
        if inner:
            start("code")
        for _ in range(draw.randint(1, 6)):
            out.append(f"{'  ' * draw.randint(0, 2)}{words(1, 1, False)} = {words(1, 1, False)}({draw.randint(0, 99)})\n")
        if inner:
            end("code")
        end("pre")

    def grid() -> None:
        start("table")
        wide = draw.randint(2, 4)
        if draw.random() < 0.2:
            filled("caption", 1, 6)
        for row in range(draw.randint(1, 6)):
            start("tr")
            for _ in range(wide):
                cell = "th" if row == 0 else "td"
                start(cell)
                out.append(words(1, 3, False) if draw.random() < 0.6 else str(draw.randint(0, 9999)))
                end(cell)
            end("tr")
        end("table")

    def terms() -> None:
        start("dl")
        for _ in range(draw.randint(1, 4)):
            filled("dt", 1, 3)
            filled("dd", 1, draw.choice((3, 20)), draw.random() < 0.5)
        end("dl")

    def only_link() -> None:
        start("p")
        linked(1, 7)
        end("p")

    def boilerplate(hint: str) -> None:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(hint)
        semantic = tag and draw.random() < 0.6
        start(tag if semantic else draw.choice(("div", "div", "section")), named(hint, 0.4 if semantic else 1.0), True)
        if hint == "menu" or hint in ("head", "foot", "side") and draw.random() < 0.5:
            link_list(2, 9)
        if hint == "head":
            start(draw.choice(("h1", "div", "span", "a")))
            out.append(words(1, 4, False))
            end(out[-2].split()[0].strip("<>"))
        if hint == "form":
            for _ in range(draw.randint(1, 3)):
                start("label")
                out.append(words(1, 3, False))
                end("label")
                number[0] += 1
                out.append("<input>")
            start("button")
            out.append(words(1, 2, False))
            end("button")
        if hint == "comment":
            for _ in range(draw.randint(1, 6)):
                start(draw.choice(("div", "article", "li")), named("comment", 0.7))
                inner = out[-1].split()[0].strip("<>")
                start("p")
                out.append(words(3, 50))
                end("p")
                end(inner)
        if hint == "foot":
            out.append("&copy; " + words(2, 14) + " &middot; " + words(1, 6))
        if hint in ("notice", "ad", "side"):
            wrapped = draw.random() < 0.5
            if wrapped:
                start(draw.choice(("p", "p", "h3")))
            inner = out[-1].split()[0].strip("<>")
            out.append(words(2, 40))
            if wrapped:
                end(inner)
        if hint == "share":
            for _ in range(draw.randint(2, 4)):
                start("a", 'href="#s"')
                out.append(words(1, 1, False))
                end("a")

    def block(hint: str) -> None:
        first = len(out)
        boilerplate(hint)
        out.append(f"</{out[first].split()[0].strip('<>')}>")

    if bare := draw.random() < 0.2:  # a fragment
        number[0] = 0
    else:
        start("head")
        start("title")
        out.append(words(3, 9, False))
        end("title")
        end("head")
        start("body")
    outer = draw.random() < 0.4
    if outer:
        start("div", named("content", 0.3))
    for hint in ("notice", "head", "menu", "ad"):
        if draw.random() < (0.15 if bare else 0.5):
            block(hint)
    side_first = draw.random() < (0.1 if bare else 0.3)
    if side_first:
        block("side")
    style = draw.random()
    if style < 0.65:
        start("article", named("content", 0.3))
        close = "article"
    elif style < 0.8:
        start("main", named("content", 0.3))
        close = "main"
    else:
        start(draw.choice(("div", "section")), named("content", 1.0))
        close = out[-1].split()[0].strip("<>")
    inner = draw.random() < 0.25
    if inner:
        start("div", named("content", 0.5))
    if draw.random() < 0.9:
        start("h1")
        out.append(words(2, 9, False))
        end("h1")
    plain = draw.random() < 0.5  # paragraphs above all
    for _ in range(draw.choice((1, 1, 1, 2, 2, 3, 4, 6, 9, 14, 30))):
        kind = draw.random()
        if kind < (0.8 if plain else 0.3):
            paragraph()
        elif kind < 0.86 and plain:
            filled(draw.choice(("h2", "h3")), 1, 7)
        elif kind < 0.93:
            draw.choice((listing, figure, code, grid, terms, only_link, only_link, listing, lambda: filled("blockquote", 8, 30, True), lambda: filled("div", 2, 40, True), lambda: filled("h2", 1, 7)))()
        else:
            block(draw.choice(("ad", "share", "form", "notice", "side")))
    if draw.random() < 0.25:
        block(draw.choice(("share", "comment")))
    if inner:
        end("div")
    end(close)
    if draw.random() < 0.3:
        start("script", drop=True)
        out.append("f(1);</script>")
    tiny = bare and draw.random() < 0.7
    for hint in ("menu",) if tiny else ("comment", "side", "form", "ad", "foot", "notice"):
        if draw.random() < (0.75 if hint == "foot" else 0.35):
            block(hint)
    if outer:
        end("div")
    whole = "".join(out)
    if draw.random() < 0.15:  # cut off
        return whole[: int(len(whole) * draw.uniform(0.6, 1))], dropped
    return whole + ("" if bare else "</body></html>"), dropped


@lru_cache(1)
def model(pages: int = 1200, seed: int = 7) -> Boosted:
    """Trees learned from generated pages."""
    draw = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        source, dropped = _generated(draw)
        page = Page(source)
        gone = [i in dropped or page.tag[i] in DROPPED for i in range(len(page.tag))]
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[page.parent[i]]
        xs.append(features(page))
        ys.append(~np.array(gone))
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def extract(sources: list[str], trees: Boosted) -> list[str]:
    """Main texts of pages."""
    parsed = [Page(s) for s in sources]
    if not parsed:
        return []
    x = [features(p) for p in parsed]
    odds = trees.score(np.concatenate(x))
    out, at = [], 0
    for page, rows in zip(parsed, x):
        mine = odds[at : at + len(rows)]
        at += len(rows)
        out.append(text_of(page, decode(page.parent, mine)))
    return out


def _mapped(trees: Boosted, names: list[str], place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                cut = batch.slice(a, 64)
                texts = extract([x or "" for x in cut.column(place).to_pylist()], trees)
                kept = [c for k, c in enumerate(cut.columns) if k != place]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return run


def main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """All columns of pages but the html, with text (the main text, empty if there is none) and n_chars.

    Null and empty pages have an empty text. Pages are taken whole and one by one: repeated rows get equal texts, an
    empty table gives an empty one. Columns that already have a new column's name are replaced.
    """
    frame = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c != source])
    kept = [f for f in frame.schema if f.name != source]
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in kept)
    return frame.mapInArrow(_mapped(model(), [*(f.name for f in kept), "text", "n_chars"], frame.columns.index(source)), f"{fields}text string, n_chars long")
