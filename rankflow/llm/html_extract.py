"""Main text of web pages: flat blocks, judged by a decision tree over word counts and link densities.

A page is a flat sequence of text blocks, cut wherever a block-level tag begins or ends.
What a block is worth shows in its word count, the share of its words in links, and the
same of its neighbours, together with what the nearest sectioning tags and the names of
classes say. A decision tree, grown here from the small table ``LABELLED``,
keeps or drops each block.

Defined results: a null or empty page has the empty text; markup that ends early or is
not closed is read as far as it goes; repeated rows are extracted one by one, and an
empty table has no rows. Other columns are left out.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.batches import cut

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button".split())
#: Those that are read as plain characters up to their end tag, and those that have none if their tag closes itself.
RAW, FOREIGN = ("script", "style", "title", "textarea", "iframe"), ("svg", "math")
#: Elements that do not end a block.
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strong "
                   "strike sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE, HEADING = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an opening tag closes without an end tag of its own (any other block ends a paragraph), and how far that reaches.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
IMPLIED_WITHIN = ("ul", "ol", "dl", "table", "div", "section", *ARTICLE)
#: Sections that are not the article, whatever their text.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Names of classes, ids and roles of such sections, by themselves or after words for where they stand and before words for
#: what they are made of. A name with any other part ('has-sidebar', 'header-fixed') says how a page is laid out.
ASIDE_NAMES = re.compile(
    r"ads?|advert[a-z]*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav[a-z]*|"
    r"newsletter|notice|pagination|popup|promo[a-z]*|related|replies|share|sharing|sidebar|social|sponsor[a-z]*|subscribe|"
    r"toolbar|widget|complementary|contentinfo|search")
NAME_BEFORE = frozenset("site page top bottom main global mobile".split())
NAME_AFTER = re.compile(r"box|bar|list|links?|buttons?|slot|unit|form|area|block|section|posts|articles|items?|signup|\d+")
NAME_PARTS = re.compile(r"[_-]+")
#: Elements that hold the page or the article; their names are no marks of an aside.
WHOLE = ("html", "body", "main", "article")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                 r"(?:((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text of one block, its words, those of them in links, and what stands around it."""

    text: str
    words: int
    linked: int
    aside: bool
    article: bool
    heading: bool


def tags(page: str) -> tuple[list[tuple[int, int, bool, str, str]], dict[int, int]]:
    """The tags of a page (start, end, whether an end tag, name, attributes), and where each ``SILENT`` element ends, by start.

    An element whose end tag is missing, or comes only after the end of what it stands in, has no end; raw text without an
    end tag goes on to the end of the head that it stands in, or else of the page.
    """
    found, ends = [], {}
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    missing: set[str] = set()
    at = 0
    while tag := TAG.search(page, at):
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            found.append((tag.start(), at, False, "", ""))
            continue
        attributes = tag[4] if tag[3] is None else tag[3]  # the fourth group holds what an open quote leaves
        found.append((tag.start(), at, bool(tag[1]), name, attributes))
        foreign = any(open_[f] for f in FOREIGN)
        empty = attributes.endswith("/")
        if tag[1]:
            while open_[name]:
                last, start = stack.pop()
                open_[last] -= 1
                if last == name:
                    if name in SILENT:
                        ends[start] = at
                    break
        elif name in VOID or empty and (name not in SILENT or name in FOREIGN or foreign):
            if name in SILENT:
                ends[tag.start()] = at
        elif name in RAW and (not foreign or name in ("script", "style")):
            end = None if name in missing else re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not end:
                missing.add(name)
                end = re.compile(r"(?=</head\s*>)", re.I).search(page, at) if open_["head"] else None
            ends[tag.start()] = at = end.end() if end else len(page)
        elif name not in INLINE:
            stack.append((name, tag.start()))
            open_[name] += 1
    return found, ends


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool]] = []
    links = asides = articles = headings = 0

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
            if text:
                linked = sum(len(html.unescape(t).split()) for t, in_link in parts if in_link)
                out.append(Block(text, len(text.split()), linked, asides > 0, articles > 0, headings > 0))
            parts.clear()

    def leave(names: tuple[str, ...], within: Sequence[str]) -> None:
        """Close the innermost open element of these names, and what is open inside it."""
        nonlocal links, asides, articles, headings
        for depth in range(len(open_) - 1, -1, -1):
            if open_[depth][0] in names:
                for gone, aside in open_[depth:]:
                    links -= gone == "a"
                    articles -= gone in ARTICLE
                    headings -= gone in HEADING
                    asides -= aside
                del open_[depth:]
                return
            if open_[depth][0] in within:
                return

    at, size = 0, len(page)
    found, ends = tags(page)
    for start, end, closing, name, attributes in [*found, (size, size, False, "", "")]:
        if start < at:
            continue
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if not name:
            continue
        if closing:
            if name not in INLINE:
                close()
            leave((name,), ())
            continue
        if name in SILENT:
            close()
            at = ends.get(start, at)
            continue
        if name not in INLINE:
            close()
            leave(IMPLIED.get(name, ("p",)), IMPLIED_WITHIN)
        if name in VOID or attributes.endswith("/"):
            continue
        names = " ".join(filter(None, (x for m in NAMES.findall(attributes) for x in m)))
        aside = name in ASIDE or (name not in WHOLE and names_aside(names))
        open_.append((name, aside))
        links += name == "a"
        articles += name in ARTICLE
        headings += name in HEADING
        asides += aside
    close()
    return out


def names_aside(names: str) -> bool:
    """Whether one of these classes, ids and roles is as a whole the name of a section beside the article."""
    for name in names.lower().split():
        parts = list(itertools.dropwhile(NAME_BEFORE.__contains__, NAME_PARTS.split(name.strip("_-"))))
        if parts and ASIDE_NAMES.fullmatch(parts[0]) and all(
                ASIDE_NAMES.fullmatch(part) or NAME_AFTER.fullmatch(part) for part in parts[1:]):
            return True
    return False


FEATURES = ("words", "link_density", "aside", "article", "elsewhere", "heading", "words_before", "link_density_before",
            "words_after", "link_density_after")


#: What counts as short text: as the tree divides it from other blocks of ``LABELLED``.
SHORT_WORDS, SHORT_LINKED = 16, 0.45


def features(found: Sequence[Block]) -> np.ndarray:
    """A row per block. ``elsewhere``: the page marks an article, and the block is outside. Neighbours are the nearest
    blocks that stand in no aside and are no short text themselves, so that all short lines of a run see what is around it."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    marked = any(b.article for b in found)
    own = np.array([[b.words, b.linked / max(b.words, 1), b.aside, b.article, marked and not b.article, b.heading]
                    for b in found], float)
    around = np.zeros((len(found), 4))
    short = (own[:, 0] <= SHORT_WORDS) & (own[:, 1] <= SHORT_LINKED)
    for side, order in ((0, range(len(found))), (2, reversed(range(len(found))))):
        near = (0.0, 0.0)
        for i in order:
            if found[i].aside:
                continue
            around[i, side:side + 2] = near
            if not short[i]:
                near = own[i, :2]
    return np.hstack([own, around])


_ANY_TEXT, _ANY_SHARE, _EITHER = (0, 1, 4, 12, 40, 200), (0.0, 1.0), (0, 1)
#: The labelled table: values of the features in their order, all of whose combinations have the label, 1 for main text.
LABELLED = (
    # sections beside the article, by tag or name, within it or not
    ((1, 12, 200), _ANY_SHARE, (1,), (1,), (0,), _EITHER, (0, 40), _ANY_SHARE, (0, 40), _ANY_SHARE, 0),
    ((1, 12, 200), _ANY_SHARE, (1,), (0,), _EITHER, _EITHER, (0, 40), _ANY_SHARE, (0, 40), _ANY_SHARE, 0),
    # outside of a marked article
    ((1, 12, 200), _ANY_SHARE, (0,), (0,), (1,), _EITHER, (0, 40), _ANY_SHARE, (0, 40), _ANY_SHARE, 0),
    # within it: text of any length, and lists of links
    ((1, 4, 12, 40, 200), (0.0, 0.4), (0,), (1,), (0,), _EITHER, _ANY_TEXT, _ANY_SHARE, _ANY_TEXT, _ANY_SHARE, 1),
    ((1, 4, 12, 40), (1.0,), (0,), (1,), (0,), _EITHER, _ANY_TEXT, _ANY_SHARE, _ANY_TEXT, _ANY_SHARE, 1),
    # pages that mark no article: text with few links, and what is short before, after or between such
    ((20, 40, 200), (0.0, 0.2), (0,), (0,), (0,), _EITHER, _ANY_TEXT, _ANY_SHARE, _ANY_TEXT, _ANY_SHARE, 1),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (20, 40, 200), (0.0, 0.2), _ANY_TEXT, _ANY_SHARE, 1),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (0, 1, 4, 10), _ANY_SHARE, (20, 40, 200), (0.0, 0.2), 1),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (20, 40, 200), (0.7, 1.0), (20, 40, 200), (0.0, 0.2), 1),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (0, 1, 4, 10), _ANY_SHARE, (0, 1, 4, 10), _ANY_SHARE, 0),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (20, 40, 200), (0.7, 1.0), (0, 1, 4, 10), _ANY_SHARE, 0),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (0, 1, 4, 10), _ANY_SHARE, (20, 40, 200), (0.7, 1.0), 0),
    ((1, 4, 10), (0.0, 0.2), (0,), (0,), (0,), _EITHER, (20, 40, 200), (0.7, 1.0), (20, 40, 200), (0.7, 1.0), 0),
    ((1, 10, 40, 200), (0.7, 1.0), (0,), (0,), (0,), _EITHER, _ANY_TEXT, _ANY_SHARE, _ANY_TEXT, _ANY_SHARE, 0),
)
TRAINING = np.array([row for group in LABELLED for row in itertools.product(*group[:-1], group[-1:])], float)


@dataclass(frozen=True)
class Node:
    """A leaf (``feature`` -1) or a test whether a feature is at most ``limit``."""

    feature: int
    limit: float
    value: float
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A decision tree by Gini impurity; of equal splits the first feature and the lowest limit."""
    mean = float(y.mean())
    best = (2 * len(y) * mean * (1 - mean) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            cost = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if cost < best[0] - 1e-9:
                best = (cost, f, float(limit))
    _, f, limit = best
    if f < 0:
        return Node(-1, 0.0, mean)
    low = x[:, f] <= limit
    return Node(f, limit, mean, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def keeps(tree: Node, row: np.ndarray) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree.value >= 0.5


def trained() -> Node:
    return grow(TRAINING[:, :-1], TRAINING[:, -1])


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found)) if keeps(tree, row))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (blocks of main text in order, a space between) and ``n_chars`` for each row."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "html"):
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return (pages.select("page_id", "url", F.coalesce(F.col(html_col), F.lit("")).alias("html"))
            .mapInArrow(run, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
