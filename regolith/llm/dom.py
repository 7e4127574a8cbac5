"""A lenient HTML reader that yields block elements, their text and their features."""

from __future__ import annotations

import functools
import html
import math
import re

import numpy as np

#: Elements that never open a level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and elements that are never read.
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
SKIP = RAW | frozenset("head noscript template iframe svg math object select button datalist audio video canvas map".split())
#: Elements that run along with the text around them; all others are blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that leave the head open.
IN_HEAD = frozenset("head noscript template object".split())
#: What an opening element closes, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: The same without heed to quotes in tags.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|(?!)()()|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: What can still begin where no > follows.
LAST = re.compile(r"<!--.*?\Z|<!\[CDATA\[.*?\Z|(?!)()()()()()", re.S)
#: Tags with an unclosed quote after which quotes no longer hide a > in the page: each of them is searched to its end.
UNCLOSED = 64
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Words in class, id and role attributes by what they tell of an element.
TOKENS = {
    "content": "article articlebody body content entry main maincontent post postbody prose story text blogpost page",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs toc tabs topnav pagination pager skip hamburger sitemap",
    "head": "header masthead top topbar logo brand site hero branding",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint credits",
    "side": "sidebar side aside rail complementary widget widgets related recommended recommendations trending popular more archive tags categories teaser readmore",
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay privacy paywall dialog toast announcement",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner dfp affiliate adslot adbox",
    "form": "form newsletter subscribe subscription signup login search contact input register",
    "comment": "comment comments commentlist commentary disqus discussion replies reply respond reader readers responses thread",
    "share": "share sharing social facebook twitter follow bookmark print email",
    "byline": "byline author meta date timestamp dateline caption figcaption credit",
}
KINDS = list(TOKENS)
KIND_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        KIND_OF.setdefault(_w, []).append(_i)

TAGS = ["p", "h1", "heading", "list", "item", "nav", "header", "footer", "aside", "article", "main", "section", "div", "form", "table", "quote"]
TAG_OF = {"p": 0, "h1": 1, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 3, "li": 4, "dt": 4, "dd": 4, "nav": 5, "header": 6, "footer": 7, "aside": 8, "article": 9, "main": 10, "section": 11, "div": 12, "form": 13, "fieldset": 13, "table": 14, "tr": 14, "td": 14, "th": 14, "tbody": 14, "thead": 14, "blockquote": 15, "pre": 15, "figure": 15}
#: Of a node's features: its tag, its attribute words, those of its ancestors, and these.
COUNTS = [
    "depth", "index", "siblings", "children", "text", "share", "links", "density", "marks", "paragraphs", "before", "length of parent's share", "own text", "alike siblings", "hidden", "inside article", "inside bad tag",
]
FEATURES = [*TAGS, *KINDS, *(f"above {k}" for k in KINDS), *COUNTS]


@functools.lru_cache(4096)
def kinds(attributes: str) -> tuple[tuple[int, ...], bool]:
    """The kinds of an element's attribute words, and whether it is hidden."""
    words = {w for x in NAMED.findall(attributes) for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())}
    return tuple(sorted({k for w in words for k in KIND_OF.get(w, ())})), bool(HIDDEN.search(attributes))


class Page:
    """The blocks of a page in document order: a block's parent comes before it. Block 0 is the page itself.

    parts holds the text in order as (block, text), with (block, " ") wherever a block or a line begins or ends."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.attributes, self.parts = [-1], ["html"], [""], []
        self.own, self.linked, self.marks = [0], [0], [0]
        self.stack = [("html", 0)]  # open elements, with their blocks
        self.open: dict[str, int] = {}  # how many of each name are open
        self.above: list[dict[str, int]] = [{}]  # of the inline ones, those since the last block was opened
        self.head = self.skip = self.links = 0  # the open head's place; how many of SKIP and of <a> are open
        stack = self.stack
        at, loose = 0, 0
        size, last = len(source), source.rfind(">")
        while at < size:
            m = (LAST if at > last else TOKEN if loose < UNCLOSED else LOOSE).search(source, at)
            end = m.start() if m else size
            if end > at and not self.skip:
                self.add(stack[-1][1], source[at:end], self.links)
            if not m:
                break
            at = m.end()
            close, name = m[1], m[2] or m[4]
            loose += m[4] is not None
            if name:
                name = name.lower()
                attributes = m[3] or m[5] or ""
                if name in RAW:
                    shut = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = shut.end() if shut else size
                    self.parts.append((stack[-1][1], " "))
                    continue
                if name in VOID:
                    if name in ("br", "hr"):
                        self.parts.append((stack[-1][1], " "))
                    continue
                if attributes.endswith("/") and name in ("svg", "path", "iframe"):
                    continue
                if name in INLINE:
                    self.push(name, stack[-1][1])
                else:
                    self.imply(name)
                    self.parent.append(stack[-1][1])
                    self.tag.append(name)
                    self.attributes.append(attributes)
                    for x in (self.own, self.linked, self.marks):
                        x.append(0)
                    self.push(name, len(self.tag) - 1)
                    self.parts.append((stack[-1][1], " "))
            elif close:
                close = close.lower()
                # an inline element ends within its block alone
                if self.above[-1].get(close) if close in INLINE else self.open.get(close):
                    i = len(stack) - 1
                    while stack[i][0] != close:
                        i -= 1
                    if close not in INLINE:
                        self.parts.append((stack[i][1], " "))
                    self.pop(i)

    def push(self, name: str, block: int) -> None:
        if name == "head" and not self.head:
            self.head = len(self.stack)
        self.stack.append((name, block))
        self.open[name] = self.open.get(name, 0) + 1
        if name in INLINE:
            self.above[-1][name] = self.above[-1].get(name, 0) + 1
        else:
            self.above.append({})
        self.skip += name in SKIP
        self.links += name == "a"

    def pop(self, first: int) -> None:
        """Closes the open elements from the place `first` on."""
        while len(self.stack) > first:
            name, _ = self.stack.pop()
            self.open[name] -= 1
            if name in INLINE:
                self.above[-1][name] -= 1
            else:
                self.above.pop()
            self.skip -= name in SKIP
            self.links -= name == "a"
        if self.head >= first:
            self.head = 0

    def imply(self, name: str) -> None:
        """Closes what the opening of a block ends: the head, an open paragraph, and items, cells and rows of its
        kind."""
        stack = self.stack
        if self.head and name not in IN_HEAD:
            self.pop(self.head)
        closed, bounds = CLOSES.get(name, ({"p"}, {"table", "td", "th", "button", "object"}))
        if not self.open.get("p") and not any(self.open.get(x) for x in closed):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in bounds:
                break
            if stack[i][0] in closed or stack[i][0] == "p":
                self.pop(i)
                break
            if name not in CLOSES and stack[i][0] not in INLINE:
                break

    def add(self, block: int, text: str, links: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append((block, text))
        n = len(text) - text.count(" ") - text.count("\n")
        self.own[block] += n
        self.linked[block] += n if links else 0
        self.marks[block] += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def features(self) -> np.ndarray:
        """A row for each block."""
        n = len(self.tag)
        parent = self.parent
        text, linked, marks = self.own[:], self.linked[:], self.marks[:]
        paragraphs = [int(t == "p" and o > 0) for t, o in zip(self.tag, self.own)]
        children, size, alike = [0] * n, [1] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            paragraphs[p] += paragraphs[i]
            size[p] += size[i]
            children[p] += 1
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            same[parent[i], self.tag[i]] = same.get((parent[i], self.tag[i]), 0) + 1
        out = np.zeros((n, len(FEATURES)), np.float32)
        depth, index, before, seen = [0] * n, [0] * n, 0, [0] * n
        above: list[frozenset[int]] = [frozenset()] * n
        article, bad = [0] * n, [0] * n
        total = max(text[0], 1)
        t0, k0, a0, c0 = 0, len(TAGS), len(TAGS) + len(KINDS), len(TAGS) + 2 * len(KINDS)
        for i in range(n):
            p = parent[i]
            own, hidden = kinds(self.attributes[i])
            if i:
                depth[i] = depth[p] + 1
                index[i] = seen[p]
                seen[p] += 1
                above[i] = above[p].union(kinds(self.attributes[p])[0]) if self.attributes[p] else above[p]
                article[i] = article[p] or self.tag[p] in ("article", "main")
                bad[i] = bad[p] or self.tag[p] in ("nav", "header", "footer", "aside", "form")
            row = out[i]
            tag = TAG_OF.get(self.tag[i])
            if tag is not None:
                row[t0 + tag] = 1
            for k in own:
                row[k0 + k] = 1
            for k in above[i]:
                row[a0 + k] = 1
            up = max(text[p], 1) if i else total
            row[c0:] = (
                depth[i], index[i], children[p] if i else 1, children[i], math.log1p(text[i]), text[i] / total, linked[i] / max(text[i], 1), math.log1p(text[i] / size[i]),
                marks[i] / max(text[i], 1) * 100, math.log1p(paragraphs[i]), before / total, text[i] / up, math.log1p(self.own[i]), same.get((p, self.tag[i]), 1), hidden, article[i], bad[i],
            )
            before += self.own[i]
        return out

    def text_of(self, kept: np.ndarray) -> str:
        """The text of the kept blocks: white space as one space, blocks joined by one."""
        return " ".join("".join(t if kept[b] else " " for b, t in self.parts).split())


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """Which blocks stay: the likeliest choice under which no block stays within one that goes.

    A block's logit is the log odds that it holds any of the main text. Keeping it adds its logit and the best of
    its children; dropping it drops all beneath. The page itself always stays."""
    n = len(page.tag)
    gain = logits.astype(np.float64).tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and gain[i] > 0
    return kept
