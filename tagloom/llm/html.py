"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities of neighbours."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tagloom import ship

_SPECIAL = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile("--!?>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "xmp", "select", "math", "canvas", "audio", "video"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose end is implied by the next block.
_LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "b", "i", "em", "strong", "u", "s", "font", "small", "big", "code", "html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
#: Words in class and id names by which parts that are not the article are known.
_BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar share sharing social related recommended comment comments discussion respond reply replies disqus pagination pager widget toolbar login search form legal copyright disclaimer skip".split()
)
#: Words by which a name only speaks of such a part, and those that an article's own parts may bear.
_ABOUT, _OWN = {"has", "with", "no", "without", "layout"}, {"header", "title", "legal", "form", "side", "body"}
_ARTICLE_NAMES = set("article post story content entry main articlebody body".split())


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: int
    boiler: int


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)} if raw.strip(" /") else {}


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of > and quotes, and for each where a tag ends that is read on from there outside of quotes; -1 if none does."""
    at = [m.start() for m in _SPECIAL.finditer(page)]
    ends, later = [-1] * (len(at) + 1), {}
    for k in range(len(at) - 1, -1, -1):
        ch = page[at[k]]
        if ch == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[later[ch] + 1] if ch in later else -1
            later[ch] = k
    return at, ends


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before a tag, name, whether it is an end tag, attributes), the rest of the page last; in one pass whatever is left open.

    Quoted > don't end a tag, but where a quote is never closed the next one does. Comments and raw elements are left out.
    """
    places, ends = _tag_ends(page)
    last, at, start = page.rfind(">"), 0, 0
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            over = _COMMENT_END.search(page, i + 4)
            yield page[start:i], "", False, ""
            at = start = over.end() if over else len(page)
            continue
        if i > last:
            break
        ch = page[i + 1]
        close = ch == "/"
        m = _NAME.match(page, i + 1 + close)
        if not m:
            if ch in "!?/":
                yield page[start:i], "", False, ""
                at = start = page.find(">", i) + 1
            else:
                at = i + 1
            continue
        end = ends[bisect_left(places, m.end())]
        if end < 0:
            end = page.find(">", i)
        yield page[start:i], m[0].lower(), close, page[m.end() : end]
        at = start = end + 1
        if not close and m[0].lower() in _RAW and page[end - 1] != "/":
            over = re.compile(rf"</{re.escape(m[0])}\s*>", re.I).search(page, at)
            at = start = over.end() if over else len(page)
    yield page[start:], "", False, ""


class _Stack:
    """Open elements, with how many of them are the article or other parts; each is pushed and popped once."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, int]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.article = self.boiler = 0

    def push(self, name: str, article: int, boiler: int) -> None:
        self.where.setdefault(name, []).append(len(self.open))
        if name not in _INLINE:
            self.blocks.append(len(self.open))
        self.open.append((name, article, boiler))
        self.article, self.boiler = self.article + article, self.boiler + boiler

    def pop(self, name: str) -> None:
        """Closes the last open element of a name and all in it; an inline one only if no block was opened in it."""
        at = self.where.get(name)
        if not at or name in _INLINE and self.blocks and at[-1] < self.blocks[-1]:
            return
        for k in range(len(self.open) - 1, at[-1] - 1, -1):
            own, article, boiler = self.open.pop()
            self.where[own].pop()
            if own not in _INLINE:
                self.blocks.pop()
            self.article, self.boiler = self.article - article, self.boiler - boiler


def _part(name: str, raw: str, article: bool) -> tuple[int, int]:
    """Whether an element is the article, and whether it is another part: by its name, role, and class and id names."""
    attrs = _attrs(raw)
    names = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())) - {""}
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    named = name not in ("body", "html", "article", "main") and not names & _ABOUT and bool(names & (_BOILER_NAMES - _OWN if article else _BOILER_NAMES))
    bad = name in _BOILER_TAGS or name == "header" and not article or role in _BOILER_ROLES or hidden or named and not (article and name in _HEADINGS)
    good = not bad and (name in ("article", "main") or role in ("main", "article") or bool(names & _ARTICLE_NAMES) and name in ("div", "section"))
    return int(good), int(bad)


def blocks(page: str | None) -> list[Block]:
    """The page's text between block tags, in order, with its share of linked words and what encloses it."""
    out: list[Block] = []
    stack = _Stack()
    links = loose = 0
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        nonlocal loose
        text = " ".join(unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(1.0, len(unescape(" ".join(linked)).split()) / n), min(stack.article, 1), min(stack.boiler + loose, 1)))
        parts.clear()
        linked.clear()
        loose = 0

    for text, name, ends, raw in _tokens(page or ""):
        if text:
            parts.append(text)
            if links:
                linked.append(text)
        if not name:
            continue
        if name not in _INLINE:
            close()
        if name == "a":
            links = 0 if ends else 1
        if name in _VOID or name in _RAW:
            continue
        if ends:
            stack.pop(name)
            continue
        good, bad = _part(name, raw, stack.article > 0)
        if name in _LOOSE:
            loose = loose or bad
        else:
            stack.push(name, good, bad)
    close()
    return out


def _rows(found: list[Block]) -> np.ndarray:
    """words, links, those of the block before and after, and place: 1 in the page's article, 0 in other parts or outside of it, 0.5 on pages that mark none."""
    marked = any(b.article and not b.boiler for b in found)
    edge = [Block("", 0, 0.0, 0, 0)]
    place = [0.0 if b.boiler or marked and not b.article else 1.0 if marked else 0.5 for b in found]
    return np.array([[b.words, b.links, p.words, p.links, n.words, n.links, k] for p, b, n, k in zip(edge + found, found, found[1:] + edge, place, strict=False)], float).reshape(-1, 7)


#: The labelled table, made by hand: pages as lists of blocks (words, link density, in an article, in another part, main text).
PAGES = [
    # articles that are marked, with menus, notices, adverts, forms and comments in parts that are marked too
    [(1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (2, 1, 0, 1, 0), (12, 0, 0, 1, 0), (9, 0, 1, 0, 1), (60, 0, 1, 0, 1), (150, 0.05, 1, 0, 1), (3, 0, 1, 0, 1), (80, 0, 1, 0, 1), (9, 0.1, 0, 1, 0)],
    [(2, 1, 0, 1, 0), (40, 0, 0, 1, 0), (1, 0, 1, 0, 1), (2, 0, 1, 0, 1), (11, 0.2, 0, 1, 0)],
    [(5, 0.4, 1, 0, 1), (6, 1, 1, 0, 1), (120, 0, 1, 0, 1), (25, 0, 1, 1, 0), (40, 0.1, 1, 1, 0), (70, 0, 1, 0, 1), (5, 1, 1, 1, 0), (90, 0, 0, 1, 0), (20, 0, 0, 1, 0)],
    [(4, 1, 0, 0, 0), (8, 0, 0, 0, 0), (14, 0, 1, 0, 1), (200, 0.1, 1, 0, 1), (30, 0, 0, 0, 0), (90, 0, 0, 0, 0), (4, 1, 0, 0, 0), (15, 0, 0, 0, 0)],
    [(3, 0, 0, 1, 0), (7, 0, 1, 0, 1), (4, 0.5, 1, 0, 1), (18, 0, 1, 0, 1), (1, 0, 1, 0, 1), (2, 1, 1, 0, 1), (33, 0, 1, 0, 1), (120, 0, 1, 1, 0), (16, 0, 0, 1, 0), (8, 1, 0, 1, 0)],
    [(5, 0, 1, 0, 1), (6, 1, 1, 0, 1), (12, 0, 1, 0, 1), (4, 1, 1, 0, 1), (2, 0, 1, 0, 1), (30, 0.9, 1, 0, 1), (8, 0, 1, 0, 1), (3, 1, 1, 0, 1), (10, 0, 1, 0, 1)],
    [(60, 0.3, 0, 0, 0), (500, 0.02, 1, 0, 1), (6, 0, 1, 0, 1), (45, 0, 0, 1, 0)],
    # pages that mark their menus and notices only
    [(1, 1, 0, 1, 0), (3, 1, 0, 1, 0), (25, 0, 0, 1, 0), (7, 0, 0, 0, 1), (80, 0, 0, 0, 1), (45, 0.05, 0, 0, 1), (100, 0, 0, 0, 1), (12, 0.1, 0, 1, 0)],
    [(2, 1, 0, 1, 0), (150, 0, 0, 1, 0), (5, 0, 0, 0, 1), (28, 0, 0, 0, 1), (10, 0, 0, 1, 0)],
    # pages that mark nothing: menus, headline, text with short lines in it, related links, footer
    [(2, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (9, 0, 0, 0, 1), (62, 0, 0, 0, 1), (118, 0.04, 0, 0, 1), (4, 0, 0, 0, 1), (75, 0, 0, 0, 1), (2, 0, 0, 0, 0), (7, 1, 0, 0, 0), (6, 1, 0, 0, 0), (8, 0.12, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (2, 1, 0, 0, 0), (4, 0.75, 0, 0, 0), (7, 0, 0, 0, 1), (41, 0, 0, 0, 1), (12, 0, 0, 0, 1), (55, 0.1, 0, 0, 1), (30, 0, 0, 0, 1), (3, 1, 0, 0, 0), (3, 1, 0, 0, 0), (5, 0.6, 0, 0, 0)],
    [(3, 1, 0, 0, 0), (2, 1, 0, 0, 0), (11, 0, 0, 0, 1), (26, 0, 0, 0, 1), (8, 0, 0, 0, 1), (90, 0.02, 0, 0, 1), (6, 0, 0, 0, 1), (48, 0, 0, 0, 1), (35, 0.06, 0, 0, 1), (2, 0, 0, 0, 0), (5, 1, 0, 0, 0), (4, 1, 0, 0, 0), (6, 0.2, 0, 0, 0), (3, 1, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (6, 0, 0, 0, 1), (22, 0, 0, 0, 1), (19, 0, 0, 0, 1), (24, 0.1, 0, 0, 1), (3, 0, 0, 0, 0), (9, 0.9, 0, 0, 0), (10, 1, 0, 0, 0), (4, 0.5, 0, 0, 0), (2, 1, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (2, 1, 0, 0, 0), (8, 0, 0, 0, 1), (58, 0, 0, 0, 1), (31, 0, 0, 0, 1), (4, 1, 0, 0, 0), (5, 1, 0, 0, 0), (7, 0, 0, 0, 0)],
    [(2, 1, 0, 0, 0), (10, 0, 0, 0, 1), (84, 0, 0, 0, 1), (5, 0, 0, 0, 1), (37, 0, 0, 0, 1), (1, 1, 0, 0, 0), (3, 1, 0, 0, 0), (12, 0, 0, 0, 0)],
    [(14, 0, 0, 0, 1), (70, 0, 0, 0, 1), (130, 0.03, 0, 0, 1), (85, 0.1, 0, 0, 1)],
    [(4, 1, 0, 0, 0), (2, 1, 0, 0, 0), (30, 0.9, 0, 0, 0), (8, 0, 0, 0, 1), (95, 0, 0, 0, 1), (3, 0, 0, 0, 1), (44, 0, 0, 0, 1), (15, 0.8, 0, 0, 0), (12, 1, 0, 0, 0), (7, 0.3, 0, 0, 0), (2, 1, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (3, 1, 0, 0, 0), (2, 0, 0, 0, 0), (2, 1, 0, 0, 0), (9, 0, 0, 0, 1), (17, 0, 0, 0, 1), (64, 0, 0, 0, 1), (20, 0.05, 0, 0, 1), (40, 0.85, 0, 0, 0), (3, 0, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0)],
    [(5, 0, 0, 0, 1), (33, 0, 0, 0, 1), (2, 0, 0, 0, 1), (51, 0, 0, 0, 1), (9, 0, 0, 0, 1), (27, 0.1, 0, 0, 1)],
    [(1, 0, 0, 0, 1)],
    [(3, 0, 0, 0, 1), (10, 0, 0, 0, 1)],
    [(2, 1, 0, 0, 0), (3, 1, 0, 0, 0), (2, 1, 0, 0, 0)],
]


def table() -> np.ndarray:
    """The labelled table: features of each block as in _rows(), then 1 for main text."""
    found = [([Block("", w, k, a, b) for w, k, a, b, _ in page], [x[-1] for x in page]) for page in PAGES]
    return np.vstack([np.column_stack((_rows(p), y)) for p, y in found])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, tree for at most it, tree for above), or the share of 1s."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= t
            cost = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@functools.cache
def tree() -> tuple | float:
    rows = table()
    return grow(rows[:, :-1], rows[:, -1])


def main_blocks(page: str | None) -> list[Block]:
    """The blocks that the tree takes for main text."""
    found = blocks(page)
    out = []
    for block, row in zip(found, _rows(found).tolist(), strict=True):
        node = tree()
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node >= 0.5:
            out.append(block)
    return out


def _extract(at: int, kept: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [" ".join(b.text for b in main_blocks(x)) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(text, pa.string())], names=[*(names[i] for i in kept), "text"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of pages besides the html, and text: the main blocks in page order, joined by one space.

    Null or empty html gives an empty text. Each row stands alone: rows that repeat get the same text. A page is read in
    one pass, whatever its length and whatever is left open in it. A column of pages that is named text is replaced.
    """
    ship(pages.sparkSession)
    names, fields = pages.columns, pages.schema.fields
    at = names.index(html_col)
    kept = [i for i, n in enumerate(names) if i != at and n.lower() != "text"]
    plain = pages.toDF(*[f"c{i}" for i in range(len(names))])  # a name with a dot would be taken for a field
    schema = StructType([fields[i] for i in kept]).add("text", StringType())
    return plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string")).mapInArrow(_extract(at, kept, names), schema)
