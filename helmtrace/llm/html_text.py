"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf tag path. Per path, the length of its text
and its sentence punctuation are summed; both ratios are smoothed along the page and fused into one score.

- *Marks.* Names of elements, classes and ids that stand for page furniture (menus, adverts, reader comments,
  ...) weigh against an element; they do not settle it. Text times score is the mass of a block. Elements of one path
  and class whose mass outweighs all unmarked text by ``1 / MARK_WEIGHT`` are wrappers that carry such a word by chance, and their
  mark is lifted, heaviest first. Elements that hold no article by the standard (``nav``, ``footer``, scripts,
  hidden ones) stay shut.
- *Content* are the paths that score at least ``THRESHOLD`` times the mean of the unmarked text. Where article or
  main elements hold at least half of it, only those count.
- *The article* is what lies in the smallest container of the content, or in the article or main element around that.
  Without such an element, headings and paragraphs right before the content belong to it, and text elements right
  after it within a common container. Where the container is the body itself, its other text needs content on both sides.

A page of links, or of furniture only, has an empty text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard by the way they are treated here.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object select option datalist canvas audio video".split())
# Of these the content is raw text up to the end tag.
LITERAL = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold running text itself, by whether they may open an article.
OPENING = HEADINGS | frozenset("p blockquote pre".split())
TEXT = OPENING | frozenset("li dt dd td th caption figcaption".split())
PAGE_LEVEL = frozenset(("", "html", "body"))
# Words in class, id or role that name page furniture. Those of LAYOUT also stand in the names of
# wrappers around the article ("with-sidebar"), so an article inside takes the mark away.
LAYOUT = frozenset(
    (
        "ad ads advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor sponsored promo promos promotion "
        "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar "
        "header masthead footer colophon sidebar sidebars aside rail widget widgets search login signup"
    ).split()
)
FURNITURE = LAYOUT | frozenset(
    (
        "comment comments commentlist disqus respond reply replies "
        "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
        "share sharing social related recommended recommendations form copyright legal complementary contentinfo"
    ).split()
)
# Of these, the words that also mark an article element: readers' comments use it too.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Marks of elements: none, by a layout word, by another furniture word, for good.
OPEN, LAID_OUT, MARKED, SHUT = range(4)
#: What a marked element's mass counts against unmarked text, and the characters outside links it needs to be a wrapper.
MARK_WEIGHT = 0.05
LEAST_PROSE = 140
#: Share of the mean score that a content path needs.
THRESHOLD = 0.7
SENTENCE_MARKS = frozenset(".,;:!?\"'()…。，、；：？！")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Block:
    """A block of text: its path, its element's number, its text, whether it lies in shut furniture, characters in links."""

    __slots__ = ("path", "node", "text", "furniture", "linked")

    def __init__(self, path, node: int, text: str, furniture: bool, linked: int):
        self.path, self.node, self.text, self.furniture, self.linked = path, node, text, furniture, linked


class Page:
    """The blocks of a page in order, and its elements, numbered as they open; number 0 is the page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.names, self.parents, self.marks, self.paths = [""], [0], [OPEN], [0]

    def ends(self) -> list[int]:
        """The last number inside each element: its descendants follow it without a gap."""
        last = list(range(len(self.names)))
        for n in range(len(last) - 1, 0, -1):
            last[self.parents[n]] = max(last[self.parents[n]], last[n])
        return last


def _mark(name: str, attributes: str, inside: bool) -> tuple[int, str]:
    """How an element is marked, and its step in the path; ``inside``: within an article or main element.

    The step of a marked element carries its class without digits, so that posts of one kind share a path.
    """
    if name in BOILERPLATE or (name == "header" and not inside):
        return SHUT, name
    mark, kind = LAID_OUT if name == "form" else OPEN, ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return SHUT, name
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return SHUT, name
            continue
        if key == "class":
            kind = _DIGITS.sub("", value)
        if name in ("html", "body", "main"):
            continue
        words = FURNITURE.intersection(_NAME_PARTS.findall(_CAMEL.sub(r"\1 \2", value).lower()))
        if inside:
            words -= {"header", "masthead"}
        if name == "article":
            words &= READERS
        if words:
            mark = max(mark, MARKED if words - LAYOUT else LAID_OUT)
    return mark, name if mark == OPEN else f"{name}!{kind}"


def read_page(html: str) -> Page:
    """The blocks and elements of a page. Never fails: broken markup is read as browsers do, roughly."""
    page = Page()
    names, parents, marks, path_of = page.names, page.parents, page.marks, page.paths
    stack: list[int] = []  # numbers of the open elements
    opened: Counter[str] = Counter()  # how many of each name are open
    shut = 0  # how many open elements are shut
    paths: dict[tuple[int, str], int] = {}  # path of the parent and the element's own step
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                node = next((n for n in reversed(stack) if names[n] not in INLINE), 0)
                page.blocks.append(Block(path_of[node], node, text, shut > 0, linked))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)

    def close(to: int) -> None:
        nonlocal shut
        for n in stack[to:]:
            opened[names[n]] -= 1
            shut -= marks[n] == SHUT
        del stack[to:]

    def close_open(name: str, *until: str) -> None:
        """Ends the innermost element of a name, unless one of ``until`` stands before it."""
        if opened[name]:
            for i in range(len(stack) - 1, -1, -1):
                if names[stack[i]] == name:
                    return close(i)
                if names[stack[i]] in until:
                    return None

    size = len(html)
    while at < size:
        less = html.find("<", at)
        if less < 0:
            text(html[at:])
            break
        text(html[at:less])
        m = _TOKEN.match(html, less)
        if not m:
            # A sign that opens nothing is text; an end tag without a name is not.
            if html.startswith("</", less):
                end = html.find(">", less)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at = less + 1
            continue
        at = m.end()
        if m[2] is None:
            if html.startswith("<![CDATA[", less):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if not m[4]:
            break  # the page ends inside a tag
        name = m[2].lower()
        if m[1]:
            if name == "br":
                text(" ")
            elif name == "p" and not opened["p"]:
                flush()
            elif opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if names[stack[i]] == name:
                        if name not in INLINE:
                            flush()
                        close(i)
                        break
                    if name in INLINE and names[stack[i]] not in INLINE:
                        break
            continue
        if name in VOID:
            if name == "br":
                text("\n")
            elif name == "hr":
                flush()
            continue
        if name in LITERAL:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if found is None:
                break
            end = html.find(">", found.end())
            at = size if end < 0 else end + 1
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_PARAGRAPH:
                close_open("p", "button", "table", "td", "th", "caption")
            if name in HEADINGS and stack and names[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if name == "li":
                close_open("li", "ul", "ol", "menu")
            elif name in ("dt", "dd"):
                close_open("dt", "dl")
                close_open("dd", "dl")
            elif name in ("td", "th"):
                close_open("td", "tr", "table")
                close_open("th", "tr", "table")
            elif name in ("tr", "tbody", "thead", "tfoot"):
                close_open("tr", "table")
        if m[3].rstrip().endswith("/") and name in RAW:
            continue
        mark, step = (SHUT, name) if name in RAW else _mark(name, m[3], opened["article"] + opened["main"] > 0)
        if name in ("article", "main") and mark == OPEN:
            # A wrapper named after the page's layout, or a form, that holds an article is no furniture.
            for n in stack:
                if marks[n] == LAID_OUT:
                    marks[n] = OPEN
        parent = stack[-1] if stack else 0
        plain = name in INLINE and mark == OPEN
        path_of.append(path_of[parent] if plain else paths.setdefault((path_of[parent], step), len(paths) + 1))
        stack.append(len(names))
        names.append(name), parents.append(parent), marks.append(mark)
        opened[name] += 1
        shut += mark == SHUT
    flush()
    return page


def path_scores(page: list[Block]) -> dict:
    """Fused score of every path: text per block times sentence marks per block, each smoothed along the page."""
    length = np.array([len(b.text) - b.linked for b in page], dtype=np.float64).clip(0)
    marks = np.array([0 if 2 * b.linked > len(b.text) else sum(map(b.text.count, SENTENCE_MARKS)) for b in page], dtype=np.float64)
    names = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in page))}
    of = np.array([names[b.path] for b in page])
    count = np.bincount(of)
    per_text, per_mark = np.bincount(of, length) / count, np.bincount(of, marks) / count
    kernel = np.array([0.125, 0.75, 0.125])

    def smooth(ratio: np.ndarray) -> np.ndarray:
        along = np.convolve(np.pad(ratio[of], 1, mode="edge"), kernel, mode="valid")
        return np.bincount(of, along) / count

    fused = np.sqrt(smooth(per_text) * (1 + smooth(per_mark)))
    return {p: float(fused[i]) for p, i in names.items()}


def _unmarked(page: Page, shown: list[Block], scores: dict) -> list[Block]:
    """The blocks outside marked elements, after the marks of wrappers are lifted, heaviest path first."""
    outer = [0]  # of each element, the path of the innermost marked element around it, itself included
    above: dict[int, int] = {}  # of each marked path, the marked path around it
    for n in range(1, len(page.names)):
        around = outer[page.parents[n]]
        if page.marks[n] in (LAID_OUT, MARKED):
            above[page.paths[n]] = around
            around = page.paths[n]
        outer.append(around)
    own: Counter[int] = Counter()  # mass of the blocks right below a marked path
    prose: Counter[int] = Counter()
    for b in shown:
        free = max(0, len(b.text) - b.linked)
        own[outer[b.node]] += free * scores[b.path]
        prose[outer[b.node]] += free
    mass, below = Counter(own), {}
    for path in sorted(above, reverse=True):  # inner ones first: a path is numbered after those around it
        mass[above[path]] += mass[path]
        prose[above[path]] += prose[path]
        below.setdefault(above[path], []).append(path)
    lifted, plain = {0}, own[0]
    heap = [(-mass[path], path) for path in below.get(0, ())]
    heapq.heapify(heap)
    while heap and -heap[0][0] * MARK_WEIGHT > plain:
        path = heapq.heappop(heap)[1]
        if prose[path] >= LEAST_PROSE:
            lifted.add(path)
            plain += own[path]
            for inner in below.get(path, ()):
                heapq.heappush(heap, (-mass[inner], inner))
    return [b for b in shown if outer[b.node] in lifted]


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by a line feed; empty for null, for no text and for furniture only."""
    page = read_page(html or "")
    shown = [b for b in page.blocks if not b.furniture]
    if not shown:
        return ""
    scores = path_scores(shown)
    kept = _unmarked(page, shown, scores)
    linked = _link_paths(kept)
    plain = [b for b in kept if b.path not in linked]
    if not plain:
        return ""
    mean = np.average([scores[b.path] for b in plain], weights=[len(b.text) for b in plain])
    content = [i for i, b in enumerate(kept) if b.path not in linked and scores[b.path] >= THRESHOLD * mean]
    frames = _frames(page)
    framed = [i for i in content if frames[kept[i].node]]
    if 2 * sum(len(kept[i].text) for i in framed) >= sum(len(kept[i].text) for i in content):
        content = framed
    ends = page.ends()
    root = _around([kept[i].node for i in content], page, ends)
    frame = frames[root]
    root = frame or root

    def under(node: int, container: int) -> bool:
        return container <= node <= ends[container]

    first, last, chosen = content[0], content[-1], set(content)
    wide = page.names[root] in PAGE_LEVEL
    dense = 0 if frame else _densest([kept[i] for i in content], page)
    for i, b in enumerate(kept):
        if not under(b.node, root):
            continue
        if b.path in linked:
            # Paths of links outside the articles and the densest part of a wide container are menus.
            if frame or frames[b.node] or (dense and under(b.node, dense)):
                chosen.add(i)
        elif not wide or first < i < last:
            chosen.add(i)
    if not frame:
        i = first - 1
        while i >= 0 and kept[i].path not in linked and page.names[kept[i].node] in OPENING:
            chosen.add(i)
            i -= 1
        i = last + 1
        while i < len(kept) and kept[i].path not in linked and page.names[kept[i].node] in TEXT and _share(kept[i].node, root, page, ends):
            chosen.add(i)
            i += 1
    return "\n".join(kept[i].text for i in sorted(chosen))


def _link_paths(page: list[Block]) -> set:
    """The paths whose text is links for the most part."""
    size: Counter = Counter()
    for b in page:
        size[b.path] += len(b.text) - 2 * b.linked
    return {p for p, rest in size.items() if rest < 0}


def _frames(page: Page) -> list[int]:
    """Of each element, the outermost article or main element around it, itself included; 0 if there is none."""
    outermost = [0]
    for n in range(1, len(page.names)):
        outermost.append(outermost[page.parents[n]] or (n if page.names[n] in ("article", "main") else 0))
    return outermost


def _around(nodes: list[int], page: Page, ends: list[int]) -> int:
    """The smallest container of all these elements; an element of running text is none."""
    root, last = min(nodes), max(nodes)
    while root and (ends[root] < last or page.names[root] in TEXT):
        root = page.parents[root]
    return root


def _share(node: int, root: int, page: Page, ends: list[int]) -> bool:
    """Whether a container below the body holds both elements."""
    while node and not node <= root <= ends[node]:
        node = page.parents[node]
    return page.names[node] not in PAGE_LEVEL


def _densest(content: list[Block], page: Page, share: float = 0.6) -> int:
    """The deepest container that holds at least ``share`` of the content text; 0 is the page."""
    held = [0] * len(page.names)
    for b in content:
        held[page.parents[b.node]] += len(b.text)
    for n in range(len(held) - 1, 0, -1):
        held[page.parents[n]] += held[n]
    # Two such containers overlap, so one lies in the other, and the deeper one opens later.
    least = share * sum(len(b.text) for b in content)
    return max(n for n, size in enumerate(held) if size >= least)


def text_column(html: Column) -> Column:
    """``main_text`` of a column."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], index=pages.index, dtype=object)

    return run(html)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "_text") -> DataFrame:
    """``pages`` with the main text in ``out_col``, which replaces a column of that name; nothing of a page is dropped before it is read."""
    return pages.withColumn(out_col, text_column(F.col(f"`{html_col}`")))
