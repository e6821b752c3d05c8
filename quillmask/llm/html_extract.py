"""HTML extraction: flat text blocks, each classified by a decision tree.

A page is read once, in time linear in its length, into a flat list of blocks:
text between block-level tags, without scripts, styles, comments and the head.
A block's features are its word count and link density, those of the block
before and after it, whether it is a heading, in a list, ends as a sentence or
is a legal line, and where it stands: in the core of the page (its
article or main element, else the container with most words), in an article or main element, in an element for page furniture, in a
box whose name says so. The tree is a small CART (Gini impurity) that is
trained on first use on the labelled table of
:mod:`quillmask.llm.labelled_pages`; no feature is preferred to another.

Character references are decoded, white space inside a block becomes one
blank, blocks are trimmed, and those of the article are joined by line feeds.

Defined results: null html counts as empty and gives empty text, as does a
page without an article; a tag that the page's end cuts off is dropped;
repeated rows are read one by one; an empty table gives an empty result.
Columns of the input are kept but the html.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmask.llm.columns import frugal
from quillmask.llm.labelled_pages import labelled

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
# a quote only opens a value after "="; possessive, so never read twice
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)>""")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*+>?", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"\s+")
_LEGAL = re.compile(r"\u00a9|\(c\)\s*(?:\d{4}|by)|\bcopyright\b|\ball rights reserved\b", re.I)
_ENDS = re.compile(r"[.!?\u2026\u3002:][\"'\u00bb\u201c\u201d\u2019)\]]*$")
#: Elements whose content is no text of the page.
RAW = frozenset("script style template textarea title noembed noframes iframe xmp".split())
SILENT = frozenset("head noscript canvas object video audio select option button datalist map desc metadata annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block; all others, and formulas and drawings, run on in the line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold others; a block's container is the nearest of them.
HOLDS = frozenset("article aside blockquote body center details dialog div fieldset figure footer form header main menu nav ol section table td ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner bottom breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus feedback footer form gdpr header imprint legal login masthead menu menubar modal nav navbar navigation newsletter notice opinions pager pagination popup promo promoted reactions recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser teasers toc toolbar topmenu widget".split()
)
#: Elements whose own name counts for nothing, as it names the whole page or article.
WHOLE = frozenset("html body article main".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "listed", "sentence", "legal", "core", "dense", "around", "page_has_main", "furniture", "named", "share")


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    named: bool
    main: bool
    heading: bool
    listed: bool
    holder: int


@functools.cache
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)


def _named(attrs: str) -> tuple[bool, bool]:
    """Whether class, id or role name furniture, and whether a role or property names the article."""
    furniture = main = False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        if key in ("class", "id", "role", "itemprop"):
            words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower()))
            main |= key == "role" and "main" in words or key == "itemprop" and "articlebody" in words
            furniture |= key != "itemprop" and bool(words & FURNITURE_WORDS)
    return furniture, main


def blocks(page: str | None) -> tuple[list[Block], list[int]]:
    """The flat text blocks of a page, in order, and the parent of each container (-1: none)."""
    page = page or ""
    out: list[Block] = []
    parents = [-1]
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []  # tag, silent, furniture, named, main, container
    open_ = Counter()  # open elements by tag, and flags by their place in a stack entry
    buffer: list[tuple[str, bool]] = []
    anchor = heading = listed = at = 0

    def flush() -> None:
        if not buffer:
            return
        text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in buffer))).strip()
        if text:
            linked = sum(len(entities.unescape(t).split()) for t, is_link in buffer if is_link)
            words = len(text.split())
            out.append(Block(text, words, min(1.0, linked / max(words, 1)), open_[2] > 0, open_[3] > 0, open_[4] > 0, heading > 0, listed > 0, stack[-1][5] if stack else 0))
        buffer.clear()

    def leave() -> str:
        nonlocal heading, listed
        entry = stack.pop()
        open_[entry[0]] -= 1
        for k in (1, 2, 3, 4):
            open_[k] -= entry[k]
        heading -= entry[0] in HEADINGS
        listed -= entry[0] == "li"
        return entry[0]

    while True:
        m = _MARKUP.search(page, at)
        if not open_[1]:
            piece = page[at : m.start() if m else len(page)]
            if piece:
                buffer.append((piece, anchor > 0))
        if not m:
            break
        tagged = _TAG.match(page, m.start())
        if not tagged:
            other = _OTHER.match(page, m.start())
            if not other:
                break  # the page ends within a tag
            at = other.end()
            continue
        at, tag, attrs = tagged.end(), tagged[2].lower(), tagged[3]
        if tag == "br":
            if not open_[1]:
                buffer.append((" ", False))
            continue
        block = tag in BLOCK or "-" in tag and tag not in SILENT
        if tagged[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            if open_[tag] <= 0:
                if block:
                    flush()
                continue
            if block:
                flush()
            while stack and leave() != tag:
                pass
            if block:
                anchor = 0
            continue
        if tag in RAW:
            end = _end_of(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block:
            flush()
        if tag in VOID or attrs.endswith("/") and not block:
            continue
        anchor += tag == "a"
        silent = tag in SILENT
        if not block and not silent:
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            leave()  # its end tag was left out
        named, main = _named(attrs) if attrs else (False, False)
        main |= tag in ("article", "main")
        furniture = tag in FURNITURE or (tag == "header" and not open_[4])
        holder = stack[-1][5] if stack else 0
        if tag in HOLDS:
            parents.append(holder)
            holder = len(parents) - 1
        stack.append((tag, silent, furniture, named and not main and tag not in WHOLE, main, holder))
        open_[tag] += 1
        for k in (1, 2, 3, 4):
            open_[k] += stack[-1][k]
        heading += tag in HEADINGS
        listed += tag == "li"
    flush()
    return out, parents


#: Part of a container's words that counts for the one around it.
INNER = 0.65


def table(found: list[Block], parents: list[int]) -> np.ndarray:
    """The features of a page's blocks, a row each."""
    n = len(found)
    own = np.array([[b.words, b.links] for b in found], float).reshape(n, 2)
    before, after = np.zeros((n, 2)), np.zeros((n, 2))
    before[1:], after[:-1] = own[:-1], own[1:]
    has_main = any(b.main for b in found)
    # a container counts the words of its blocks that are in no link or legal line, and a part of those of the containers in it
    weight = np.zeros(len(parents))
    holders = np.array([b.holder for b in found], np.int64)
    legal = np.array([b.words < 60 and _LEGAL.search(b.text) is not None for b in found], bool)
    inside = np.array([b.main or not has_main for b in found], bool)  # what stands outside the article element counts nothing
    np.add.at(weight, holders, own[:, 0] * (1 - own[:, 1]) * (inside & ~legal))
    total = weight.copy()
    for k in range(len(parents) - 1, 0, -1):
        total[parents[k]] += INNER * total[k]
    dense = np.zeros(len(parents), bool)
    best = int(np.argmax(total))
    dense[best] = True
    around = dense.copy()
    around[max(parents[best], 0)] = True
    for k in range(1, len(parents)):
        dense[k] |= dense[parents[k]]
        around[k] |= around[parents[k]]
    rest = [[b.heading, b.listed, _ENDS.search(b.text) is not None, law, b.main if has_main else dense[b.holder], dense[b.holder], around[b.holder], has_main, b.furniture, b.named] for b, law in zip(found, legal, strict=True)]
    share = total[holders] / max(total.max(initial=0), 1)
    return np.hstack([own, before, after, np.array(rest, float).reshape(n, 10), share[:, None]])


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: bool = False


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


#: Blocks of the labelled table in a leaf of the tree, at least, and its depth.
LEAST_IN_LEAF = 4
DEPTH = 9


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST_IN_LEAF) -> Node:
    """A CART: the split that leaves the least Gini impurity, again and again; of equals the first in FEATURES."""
    node = Node(label=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    best = (_gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = _gini(y[low]) + _gini(y[~low])
            if impurity < best[0] - 1e-9:
                best = (impurity, f, float(limit))
    if best[1] < 0:
        return node
    low = x[:, best[1]] < best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least), node.label)


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    """The tree's label for each row."""
    if node.feature < 0 or node.low is None or node.high is None:
        return np.full(len(x), node.label)
    low = x[:, node.feature] < node.limit
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(node.low, x[low]), decide(node.high, x[~low])
    return out


def examples(pages: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    return np.vstack([table(*blocks(page)) for _, page, _ in pages]), np.array([c == "+" for _, _, marks in pages for c in marks])


@functools.cache
def trained() -> Node:
    return grow(*examples(labelled()))


def main_text(page: str | None) -> str:
    """The article's text of a page."""
    found, parents = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, decide(trained(), table(found, parents)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The input without ``html`` and with the main text in column ``into``."""
    pages = pages.drop(*({into} & set(pages.columns)))
    schema = T.StructType([f for f in pages.schema if f.name != html] + [T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                names = [n for n in batch.schema.names if n != html]
                texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], [*names, into])

    return pages.mapInArrow(frugal(run), schema)
