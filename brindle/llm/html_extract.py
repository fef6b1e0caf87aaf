"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.html_layouts import LAYOUTS
from brindle.llm.shared import ship, text_of

# HTML's element names by their role here.
#: Elements whose content is never text of the page. Not head: its end tag is optional, and text in it ends it.
SKIPPED = frozenset("script style noscript template iframe svg math canvas object audio video title textarea select option datalist".split())
#: Elements that stand beside the main text, by their meaning in HTML; header does where it heads no part of the page.
ASIDE = frozenset("nav aside footer menu dialog button".split())
#: Elements inside a line of text; every other one ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start tag closes an open one of the same name.
CLOSES = frozenset("p li option tr td th dt dd".split())
#: A block's element: other ones, parts of lists and tables, paragraphs, headings.
OTHER, LISTED, PARAGRAPH, HEADING = range(4)
ELEMENT = dict.fromkeys("li dt dd td th caption".split(), LISTED) | dict.fromkeys("p blockquote pre figcaption".split(), PARAGRAPH) | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), HEADING)
#: What a block is a part of: nothing, a section, main, an article.
NOTHING, SECTION, MAIN, ARTICLE = range(4)

#: Attributes by HTML's rules: a quote opens a quoted value only right after the equals sign.
ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg)\b{ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{ATTRS})>|<[!?/][^>]*>|<[a-zA-Z/!][^<>]*\Z",
    re.S | re.I,
)
HREF = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """A run of text between tags that end a line: ``links`` of its words are in links; ``part`` numbers the article, main or
    section that it is in (see NOTHING ... ARTICLE for ``kind``); ``beside`` and ``form``: whether such an element is around it."""

    text: str
    words: int
    links: int
    element: int
    kind: int
    part: int
    beside: bool
    form: bool


class Place(NamedTuple):
    """What is open around a piece of text."""

    kind: int = NOTHING
    part: int = 0
    beside: bool = False
    form: bool = False
    element: int = OTHER

    def inside(self, name: str, number: int) -> Place:
        """The place inside a start tag: the innermost article counts, else the outermost main, else the outermost section."""
        kind, part = self.kind, self.part
        if name == "article" or (name == "main" and kind < MAIN) or (name == "section" and kind == NOTHING):
            kind, part = {"article": ARTICLE, "main": MAIN, "section": SECTION}[name], number
        element = self.element if name in INLINE else ELEMENT.get(name, OTHER if name != "br" else self.element)
        return Place(kind, part, self.beside or name in ASIDE or (name == "header" and self.kind == NOTHING), self.form or name == "form", element)


def blocks(html: str) -> list[Block]:
    """The page as flat blocks in order. Only blocks with text are listed."""
    found: list[Block] = []
    stack: list[tuple[str, Place, bool]] = []  # open elements, the place around them, whether they are links
    pieces: list[str] = []
    linked: list[str] = []
    place, links, skipping, at, number = Place(), 0, 0, 0, 0

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                found.append(Block(text, text.count(" ") + 1, len(unescape("".join(linked)).split()), place.element, place.kind, place.part, place.beside, place.form))
            pieces, linked = [], []

    def leave(k: int) -> None:
        """Pop open elements down to number k."""
        nonlocal place, links, skipping
        for name, before, link in reversed(stack[k:]):
            place = before
            links -= link
            skipping -= name in SKIPPED
        del stack[k:]

    def leave_open(name: str, through: frozenset) -> None:
        """End an open element of the name, if only elements of ``through`` are inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return leave(k)
            if stack[k][0] not in through:
                return None

    def add(text: str) -> None:
        if text and not skipping:
            pieces.append(text)
            if links:
                linked.append(text)

    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            close()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        if name in CLOSES:
            leave_open(name, INLINE | CLOSES)
        elif name == "a":
            leave_open("a", INLINE)
        elif name not in INLINE and name not in VOID:
            leave_open("p", INLINE)
        if name in VOID:
            continue
        number += 1
        link = name == "a" and HREF.search(m["attrs"]) is not None
        stack.append((name, place, link))
        place = place.inside(name, number)
        links += link
        skipping += name in SKIPPED
    add(html[at:])
    close()
    return found


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of the block before, of the block and of the block after (zeros beyond
    the ends); the most plain words in one of the three blocks before and after; its element; what it is part of, the words of that
    part as a share of the largest part's, whether the part has a heading if any article has; whether it stands beside,
    or in a form; whether the page has a main or an article."""
    n = len(page)
    words = np.array([0, *[b.words for b in page], 0], dtype=float)
    links = np.array([0, *[b.links for b in page], 0], dtype=float)
    density = np.minimum(1, links / np.maximum(words, 1))
    plain = np.maximum(words - links, 0)
    padded = np.concatenate((np.zeros(2), plain, np.zeros(2)))
    before, after = (np.max([padded[k + i : k + i + n] for i in range(3)], axis=0) for k in (0, 4))
    sums: dict[int, float] = {}
    headed: set[int] = set()
    for b, x in zip(page, plain[1:-1]):
        if b.kind and not b.beside:
            sums[b.part] = sums.get(b.part, 0) + x
            if b.element == HEADING:
                headed.add(b.part)
    most = max(sums.values(), default=0) or 1
    has_main = any(b.kind >= MAIN and not b.beside for b in page)
    missed = any(b.kind == ARTICLE and b.part in headed for b in page)
    rest = [(b.element, b.kind, sums.get(b.part, 0) / most if b.kind else 0, b.kind and (b.part in headed or not missed), b.beside, b.form, has_main) for b in page]
    return np.column_stack([x for k in (0, 1, 2) for x in (words[k : k + n], density[k : k + n])] + [before, after, np.array(rest, dtype=float).reshape(n, 7)])


def labelled(scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LAYOUTS, with counts of three words or more scaled."""
    x, y = [], []
    for line in LAYOUTS.strip().split("\n"):
        page = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * (int(m[1]) if int(m[1]) < 3 else max(2, round(int(m[1]) * scale)))), line))
        x.append(features(page))
        y += [b.text.startswith("+") for b in page]
    return np.concatenate(x), np.array(y, dtype=float)


def grow(x: np.ndarray, y: np.ndarray, least: int = 2, depth: int = 10) -> dict:
    """A binary decision tree by Gini impurity; ties go to the earlier feature and the lower threshold."""
    share = y.mean()
    if depth == 0 or len(y) < 2 * least or share in (0, 1):
        return {"p": share}
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            n = left.sum()
            if least <= n <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                impurity = 2 * (a * (1 - a) * n + b * (1 - b) * (len(y) - n))
                if impurity < best[0] - 1e-9:
                    best = (impurity, f, t)
    if best[1] is None:
        return {"p": share}
    left = x[:, best[1]] < best[2]
    return {"f": best[1], "t": best[2], "low": grow(x[left], y[left], least, depth - 1), "high": grow(x[~left], y[~left], least, depth - 1)}


@lru_cache(maxsize=1)
def tree() -> dict:
    """Grown once from the labelled layouts, at their sizes and at smaller and larger ones."""
    parts = [labelled(s) for s in (0.6, 1.0, 1.7)]
    return grow(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def classify(node: dict, x: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    if "p" in node:
        return np.full(len(x), node["p"] >= 0.5)
    low = x[:, node["f"]] < node["t"]
    out = np.zeros(len(x), dtype=bool)
    if low.any():
        out[low] = classify(node["low"], x[low])
    if not low.all():
        out[~low] = classify(node["high"], x[~low])
    return out


def extract(html: str) -> str:
    """The main text of a page: its main blocks in order, joined by one \\n."""
    page = blocks(html)
    if not page:
        return ""
    keep = classify(tree(), features(page))
    return "\n".join(b.text for b, k in zip(page, keep) if k)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars; one row per row of ``pages``.

    A block is the text between two tags that end a line of text. Its features are its number of words and link
    density, those of its neighbours, and the elements that it stands in (see features); names of classes, ids and
    roles are not read. A decision tree decides, grown from a table of labelled layouts (html_layouts). White space inside a
    block becomes one space, character references are decoded; nothing else of a main block is dropped. No shuffle.

    Defined cases: null and empty pages have an empty text; cut-off tags and unclosed elements end with the
    page; very long pages are read whole, in time that grows with their length; where thresholds of the tree are met, a
    value goes to the upper side, and an even leaf counts as main text; nulls in id or url stay null; repeated rows
    repeat; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("html"))
    return narrow.mapInPandas(run, "page_id long, url string, text string, n_chars long")
