"""HTML extraction by shallow text features.

A page becomes a flat list of text blocks. Each block has its words, its link density, the same of the blocks before and
after, and what encloses it: a part that is no main text (menus, page headers, footers, sidebars, notices, adverts,
comments, by tag or by class and id), a form, or an article. A decision tree, grown on the small labelled table ``EXAMPLES``,
tells main text from the rest; the main blocks in page order are the text. Tags don't decide alone, except for named parts: a
form can wrap a whole page and then its long plain blocks are text, and pages without an article are told by words and link
density of a block and its neighbours only. Neighbouring blocks of nothing but links are one run and are judged as one, by the
blocks around them: three or more of them at the head or end of an article are a menu or teasers, between its paragraphs a list.

A class or id names a part by a whole word of it: listed itself, or made of a listed word and words for places ("ad-slot", "site-footer"), not
"ad-free", "no-comments" or "related-work". A named part that holds the page's only article, or most plain words of a page without
one, is not dropped for its name; comments are.

Cases: null html is empty; cut-off pages end with their last whole tag; an unknown or unclosed tag closes with what
encloses it; character references are decoded block by block, those cut off stay as they are; repeated rows get equal
results; pages are taken whole; an empty table gives no rows; further columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow mfrac msup msub msqrt".split())
ASIDE = frozenset("nav header footer aside menu dialog head button select".split())
MAIN = frozenset(("article", "main"))
#: Words of a class or id that name what isn't main text.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu sidebar footer comment comments reply replies "
    "disqus cookie cookies consent notice popup modal newsletter subscribe share social related breadcrumb breadcrumbs pagination widget header".split()
)
#: Words that say what kind of part a name is for, and words before a name that say something else about what has them.
PLACES = frozenset("area bar block box body container content footer form group header inner item items left link links list main outer panel posts primary right row section slot stories top bottom unit widget wrap wrapper".split())
OTHERS = frozenset("no not non with without has have hide hides is in under by".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']+|\"[^\"<]*\"|'[^'<]*')*+)/?>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?][^>]*>|<[/!?]?[A-Za-z][^<>]*\Z",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: The table the tree is grown on: in such a part, in a form, in an article or main part, page has one of these, words, link density,
#: words before, link density before, words after, link density after, is main text. ``_RUNS`` have the number of blocks in their run of links
#: before the last, or 0 for blocks of other text.
FEATURES = ("aside", "in_form", "in_article", "has_article", "words", "links", "words_before", "links_before", "words_after", "links_after", "run")
#: A block with a link density from here on is nothing but links.
LINKS = 0.9
_SINGLE = (
    (1, 0, 0, 1, 6, 1.0, 0, 0.0, 5, 1.0, 0), (1, 0, 0, 1, 30, 0.0, 5, 1.0, 12, 0.0, 0), (1, 0, 0, 0, 25, 0.0, 40, 0.0, 3, 0.0, 0), (1, 0, 1, 1, 3, 1.0, 60, 0.0, 4, 1.0, 0),
    (1, 0, 1, 1, 45, 0.0, 80, 0.0, 20, 0.1, 0), (1, 0, 0, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (1, 0, 0, 1, 14, 0.2, 90, 0.0, 0, 0.0, 0), (1, 0, 0, 0, 60, 0.1, 70, 0.0, 80, 0.0, 0),
    (0, 0, 1, 1, 120, 0.0, 9, 0.0, 80, 0.0, 1), (0, 0, 1, 1, 1, 0.0, 40, 0.0, 60, 0.0, 1), (0, 0, 1, 1, 8, 0.0, 0, 0.0, 90, 0.0, 1), (0, 0, 1, 1, 2, 1.0, 30, 0.0, 3, 0.5, 1),
    (0, 0, 1, 1, 45, 0.1, 70, 0.0, 12, 0.0, 1), (0, 0, 1, 1, 5, 0.0, 5, 0.0, 5, 0.0, 1), (0, 0, 1, 1, 400, 0.0, 3, 1.0, 0, 0.0, 1), (0, 0, 1, 1, 3, 0.0, 2, 1.0, 0, 0.0, 1),
    (0, 0, 0, 1, 20, 0.0, 4, 1.0, 10, 0.0, 0), (0, 0, 0, 1, 4, 1.0, 0, 0.0, 5, 1.0, 0), (0, 0, 0, 1, 60, 0.0, 100, 0.0, 9, 0.3, 0), (0, 0, 0, 1, 7, 0.0, 60, 0.0, 0, 0.0, 0),
    (0, 0, 0, 0, 90, 0.0, 10, 0.0, 70, 0.0, 1), (0, 0, 0, 0, 40, 0.1, 80, 0.0, 60, 0.0, 1), (0, 0, 0, 0, 25, 0.0, 30, 0.0, 22, 0.0, 1), (0, 0, 0, 0, 9, 0.0, 50, 0.0, 70, 0.0, 1),
    (0, 0, 0, 0, 6, 0.0, 3, 1.0, 85, 0.0, 1), (0, 0, 0, 0, 16, 0.0, 64, 0.0, 2, 1.0, 1), (0, 0, 0, 0, 3, 1.0, 2, 1.0, 4, 1.0, 0), (0, 0, 0, 0, 12, 0.9, 90, 0.0, 8, 1.0, 0),
    (0, 0, 0, 0, 5, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 4, 0.6, 70, 0.0, 3, 0.8, 0), (0, 0, 0, 0, 30, 0.8, 5, 1.0, 6, 1.0, 0), (0, 0, 0, 0, 2, 1.0, 60, 0.0, 60, 0.0, 0),
    (1, 0, 0, 1, 12, 0.0, 30, 0.0, 4, 0.0, 0), (1, 0, 1, 1, 22, 0.0, 14, 0.0, 60, 0.0, 0), (1, 0, 0, 0, 8, 0.0, 0, 0.0, 9, 0.0, 0), (1, 0, 0, 0, 3, 0.0, 90, 0.0, 0, 0.0, 0),
    (1, 0, 0, 1, 90, 0.0, 0, 0.0, 40, 0.0, 0), (1, 0, 1, 1, 5, 0.0, 3, 0.0, 3, 0.0, 0), (1, 0, 0, 0, 35, 0.0, 20, 0.0, 15, 0.0, 0), (1, 0, 0, 1, 2, 0.0, 2, 0.0, 300, 0.0, 0),
    (0, 0, 1, 1, 2, 0.0, 3, 0.0, 4, 0.0, 1), (0, 0, 1, 1, 4, 0.8, 3, 0.0, 4, 0.5, 1), (0, 0, 1, 1, 14, 0.3, 4, 1.0, 90, 0.0, 1), (0, 0, 1, 1, 30, 0.6, 0, 0.0, 2, 1.0, 1),
    (0, 0, 0, 1, 35, 0.0, 35, 0.0, 35, 0.0, 0), (0, 0, 0, 1, 2, 0.0, 90, 0.0, 90, 0.0, 0), (0, 0, 0, 1, 90, 0.0, 3, 0.0, 3, 0.0, 0), (0, 0, 0, 1, 12, 0.0, 0, 0.0, 0, 0.0, 0),
    (0, 0, 0, 0, 30, 0.05, 50, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 1, 1.0, 1, 1.0, 90, 0.0, 0), (0, 0, 0, 0, 8, 0.0, 60, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 1, 0.0, 30, 0.0, 0, 0.0, 1),
    (0, 0, 0, 0, 3, 0.0, 0, 0.0, 5, 0.0, 1), (0, 0, 0, 0, 10, 0.95, 0, 0.0, 12, 1.0, 0), (0, 0, 0, 0, 70, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 6, 1.0, 40, 0.1, 0, 0.0, 0),
    (0, 0, 1, 1, 3, 1.0, 2, 1.0, 4, 1.0, 0), (0, 0, 1, 1, 6, 1.0, 5, 1.0, 7, 1.0, 0), (0, 0, 1, 1, 9, 1.0, 8, 0.95, 8, 1.0, 0), (0, 0, 1, 1, 2, 1.0, 1, 1.0, 2, 1.0, 0),
    (0, 0, 1, 1, 5, 1.0, 30, 0.0, 6, 1.0, 1), (0, 0, 1, 1, 4, 1.0, 5, 1.0, 40, 0.0, 1), (0, 0, 1, 1, 6, 1.0, 50, 0.0, 60, 0.0, 1), (0, 0, 1, 1, 8, 0.5, 6, 1.0, 7, 1.0, 1),
    (0, 0, 1, 1, 20, 0.2, 6, 1.0, 5, 1.0, 1), (0, 0, 1, 1, 4, 0.0, 3, 1.0, 4, 1.0, 1), (0, 0, 1, 1, 3, 1.0, 20, 0.3, 4, 0.6, 1), (0, 0, 1, 1, 2, 0.0, 2, 0.0, 0, 0.0, 1),
    (0, 1, 0, 0, 70, 0.0, 60, 0.0, 80, 0.0, 1), (0, 1, 0, 0, 45, 0.05, 50, 0.0, 60, 0.0, 1), (0, 1, 1, 1, 90, 0.0, 50, 0.0, 70, 0.1, 1), (0, 1, 0, 0, 120, 0.1, 4, 1.0, 60, 0.0, 1),
    (0, 1, 0, 0, 3, 0.0, 2, 0.0, 4, 0.0, 0), (0, 1, 1, 1, 2, 0.0, 60, 0.0, 1, 0.0, 0), (0, 1, 1, 1, 12, 0.0, 40, 0.0, 70, 0.0, 0), (0, 1, 0, 1, 9, 0.1, 0, 0.0, 3, 0.0, 0),
    (0, 1, 1, 1, 25, 0.0, 1, 0.0, 2, 0.0, 0), (0, 1, 0, 0, 20, 0.9, 3, 1.0, 4, 1.0, 0), (0, 1, 0, 1, 18, 0.0, 2, 0.0, 1, 0.0, 0), (0, 1, 1, 1, 5, 1.0, 30, 0.0, 2, 0.0, 0),
    (0, 1, 0, 0, 60, 0.9, 5, 1.0, 3, 1.0, 0), (0, 1, 1, 1, 30, 0.0, 3, 0.0, 60, 0.0, 0), (0, 1, 0, 0, 1, 0.0, 60, 0.0, 60, 0.0, 0), (0, 1, 0, 0, 15, 0.0, 80, 0.0, 50, 0.0, 0),
    (0, 0, 0, 0, 60, 0.0, 90, 0.0, 140, 0.0, 1), (0, 0, 0, 0, 4, 0.0, 3, 1.0, 120, 0.0, 1), (0, 0, 0, 0, 5, 0.0, 80, 0.0, 95, 0.0, 1), (0, 0, 0, 0, 6, 0.0, 40, 0.0, 30, 0.0, 1),
    (0, 0, 0, 0, 110, 0.0, 100, 0.1, 130, 0.1, 1), (0, 0, 0, 0, 12, 0.2, 100, 0.0, 100, 0.0, 1), (0, 0, 0, 0, 2, 0.0, 90, 0.0, 3, 1.0, 0), (0, 0, 0, 0, 1, 0.0, 12, 0.0, 2, 1.0, 0),
    (0, 0, 0, 0, 3, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 2, 0.0, 1, 1.0, 1, 1.0, 0), (0, 0, 0, 0, 4, 0.0, 60, 0.0, 5, 1.0, 0), (0, 0, 0, 0, 1, 0.0, 3, 1.0, 2, 1.0, 0),
    (0, 0, 0, 0, 40, 0.1, 4, 0.0, 2, 0.0, 1), (0, 0, 0, 0, 7, 0.0, 12, 0.1, 100, 0.0, 1), (0, 0, 0, 0, 2, 0.0, 110, 0.0, 45, 0.0, 1), (0, 0, 0, 0, 22, 0.3, 25, 0.0, 4, 1.0, 1),
)


_RUNS = (
    (0, 0, 1, 1, 3, 1.0, 0, 0.0, 60, 0.0, 3, 0), (0, 0, 1, 1, 6, 1.0, 0, 0.0, 9, 0.0, 5, 0), (0, 0, 1, 1, 2, 1.0, 8, 0.0, 0, 0.0, 6, 0), (0, 0, 1, 1, 9, 1.0, 70, 0.0, 0, 0.0, 4, 0),
    (0, 0, 1, 1, 5, 1.0, 30, 0.0, 0, 0.0, 12, 0), (0, 0, 1, 1, 2, 1.0, 1, 0.0, 0, 0.0, 8, 0), (0, 0, 1, 1, 2, 1.0, 0, 0.0, 1, 0.0, 9, 0), (0, 0, 1, 1, 4, 1.0, 0, 0.0, 0, 0.0, 7, 0),
    (0, 0, 1, 1, 3, 1.0, 40, 0.0, 60, 0.0, 6, 1), (0, 0, 1, 1, 7, 1.0, 12, 0.1, 90, 0.0, 3, 1), (0, 0, 1, 1, 2, 1.0, 5, 0.0, 25, 0.2, 15, 1), (0, 0, 1, 1, 10, 1.0, 80, 0.0, 6, 0.0, 4, 1),
    (0, 0, 1, 1, 4, 1.0, 50, 0.0, 40, 0.0, 2, 1), (0, 0, 1, 1, 6, 1.0, 0, 0.0, 70, 0.0, 2, 1), (0, 0, 1, 1, 3, 1.0, 60, 0.0, 0, 0.0, 2, 1), (0, 0, 1, 1, 5, 1.0, 0, 0.0, 0, 0.0, 2, 1),
    (0, 0, 1, 1, 3, 1.0, 60, 0.0, 0, 0.0, 1, 1), (0, 0, 1, 1, 3, 1.0, 0, 0.0, 60, 0.0, 1, 1), (0, 0, 0, 0, 3, 1.0, 0, 0.0, 60, 0.0, 5, 0), (0, 0, 0, 0, 5, 1.0, 60, 0.0, 0, 0.0, 6, 0),
    (0, 0, 0, 0, 4, 1.0, 60, 0.0, 70, 0.0, 4, 0), (0, 0, 0, 0, 3, 1.0, 2, 0.0, 5, 0.0, 3, 0), (0, 0, 0, 1, 5, 1.0, 30, 0.0, 0, 0.0, 4, 0), (0, 0, 0, 0, 6, 1.0, 0, 0.0, 0, 0.0, 9, 0),
    (0, 0, 1, 1, 12, 0.85, 60, 0.0, 0, 0.0, 0, 0), (0, 0, 1, 1, 20, 0.8, 30, 0.0, 0, 0.0, 0, 0), (0, 0, 1, 1, 9, 0.85, 6, 0.0, 0, 0.0, 0, 0), (0, 0, 1, 1, 15, 0.8, 0, 0.0, 60, 0.0, 0, 0),
    (0, 0, 1, 1, 30, 0.85, 90, 0.0, 0, 0.0, 0, 0), (0, 0, 1, 1, 10, 0.85, 0, 0.0, 8, 0.0, 0, 0), (0, 0, 1, 1, 14, 0.85, 50, 0.0, 60, 0.0, 0, 1), (0, 0, 1, 1, 30, 0.7, 8, 0.0, 12, 0.0, 0, 1),
    (0, 1, 0, 0, 3, 1.0, 60, 0.0, 50, 0.0, 4, 0), (0, 1, 1, 1, 4, 1.0, 0, 0.0, 60, 0.0, 5, 0), (1, 0, 0, 1, 3, 1.0, 0, 0.0, 4, 0.0, 6, 0), (1, 0, 1, 1, 3, 1.0, 60, 0.0, 4, 0.0, 5, 0),
)
#: A run of links has no neighbours that are links, so single rows of that kind say nothing.
#: In an article plain blocks of any length are text, whatever stands around them.
EXAMPLES = (
    *((*r[:-1], int(r[5] >= LINKS), r[-1]) for r in _SINGLE if r[0] or r[5] < LINKS or max(r[7], r[9]) < LINKS), *_RUNS,
    *((0, 0, 1, 1, words, 0.0, before, 0.0, after, 0.0, 0, 1) for words in (1, 3, 9, 40, 150) for before in (0, 3, 70) for after in (0, 3, 70)),
)


@dataclass(frozen=True)
class Node:
    main: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def judge(self, x: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.threshold else node.high
        return node.main


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """A tree by Gini impurity; ties go to the earlier feature and the lower threshold."""

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    main = 2 * sum(r[-1] for r in rows) >= len(rows)
    if not depth or impurity(rows) == 0:
        return Node(main)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None:
        return Node(main)
    return Node(main, best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1))


@cache
def tree() -> Node:
    return grow(list(EXAMPLES))


@dataclass
class Block:
    aside: bool
    in_form: bool
    in_article: bool
    part: int = -1
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)

    def close(self) -> None:
        self.text = " ".join("".join(self.pieces).split())
        self.words = len(self.text.split())
        self.links = min(1.0, sum(len(x.split()) for x in self.linked) / self.words) if self.words else 0.0


def _named(attributes: str, in_article: bool) -> frozenset[str]:
    """The listed words that a class, id or role names its element by."""
    found: set[str] = set()
    for m in NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            listed = [w for w in words if w in ASIDE_NAMES]
            if listed and words[0] not in OTHERS and (words[-1] in ASIDE_NAMES or all(w in PLACES or w in ASIDE_NAMES for w in words)):
                found.update(listed)
    return frozenset(found - ({"header"} if in_article else set()))


@dataclass
class Part:
    """A named part, the one around it or -1, and what it holds."""

    around: int
    comments: bool
    article: bool = False
    plain: int = 0


@dataclass(frozen=True)
class Open:
    """An open element: what holds inside it, and the place of the paragraph that it or only inline elements of it continue, or -1."""

    tag: str
    aside: bool = False
    in_form: bool = False
    in_article: bool = False
    part: int = -1
    paragraph: int = -1


def _dropped(parts: list[Part], found: list[Block], apart: bool) -> list[bool]:
    """Whether each named part goes for its name or lies in one that does. ``apart``: an article stands outside of all of them."""
    total = 0
    for b in found:
        if not b.aside:
            plain = round(b.words * (1 - b.links))
            total += plain
            k = b.part
            while k >= 0:
                parts[k].plain += plain
                k = parts[k].around
    out: list[bool] = []
    for p in parts:  # those around come first
        kept = not apart and not p.comments and (p.article or (2 * p.plain > total and not any(q.article for q in parts)))
        out.append(not kept or (p.around >= 0 and out[p.around]))
    return out


def blocks(html: str) -> tuple[list[Block], bool]:
    """The page's blocks that have words, and whether it has an article."""
    out: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # by tag: where in the stack it is open; so that closing tags need no search
    page = Open("")
    holds = (False, False, False, -1)
    has_article = apart = False
    parts: list[Part] = []
    links, now, at, skip_to = 0, Block(*holds), 0, None

    def end_block() -> Block:
        if now.pieces:
            now.close()
            if now.words:
                out.append(now)
        return Block(*holds)

    def close_from(k: int) -> bool:
        """Closes all elements from this place on; whether all were inline."""
        nonlocal links
        inline = True
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            links -= tag == "a"
            inline = inline and tag in INLINE
        return inline

    for m in TOKEN.finditer(html):
        if skip_to is not None:
            if not ((m[1] or m[4]) and (m[2] or m[5]).lower() == skip_to):
                continue
            at, skip_to = m.end(), None
            continue
        if m.start() > at:
            piece = unescape(html[at : m.start()])
            now.pieces.append(piece)
            if links:
                now.linked.append(piece)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                skip_to = name
            continue
        if name == "br":
            now.pieces.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                now = end_block()
            continue
        if closing:
            if not places.get(name):
                continue
            inline = close_from(places[name][-1])
        else:
            inline = name in INLINE
            if not inline and stack and stack[-1].paragraph >= 0:  # a block ends the paragraph and the inline elements it is in
                close_from(stack[-1].paragraph)
            up = stack[-1] if stack else page
            main = name in MAIN
            has_article |= main
            off = up.aside or (name in ASIDE and not (name == "header" and up.in_article))
            part, names = up.part, _named(attributes, up.in_article) if attributes and name not in ("html", "body") else None
            if main and not off:
                apart |= part < 0 and not names
                k = part
                while k >= 0 and not parts[k].article:
                    parts[k].article = True
                    k = parts[k].around
            if names:
                parts.append(Part(part, bool(names & COMMENTS), main and not off))
                part = len(parts) - 1
            paragraph = len(stack) if name == "p" else up.paragraph if inline else -1
            places.setdefault(name, []).append(len(stack))
            stack.append(Open(name, off, up.in_form or name == "form", up.in_article or main, part, paragraph))
            links += name == "a"
        was, top = holds, stack[-1] if stack else page
        holds = (top.aside, top.in_form, top.in_article, top.part)
        if not inline or was != holds:
            now = end_block()
    if skip_to is None and at < len(html):
        now.pieces.append(unescape(html[at:]))
    end_block()
    gone = _dropped(parts, out, apart)
    for b in out:
        b.aside |= b.part >= 0 and gone[b.part]
    return out, has_article


def extract(html: str | None) -> str:
    """The main text: its blocks joined by newlines."""
    found, has_article = blocks(html or "")
    judge, none, kept, i = tree().judge, (0, 0.0), [], 0
    size = lambda k: (found[k].words, found[k].links) if 0 <= k < len(found) else none
    while i < len(found):
        b, j = found[i], i + 1
        context = (b.aside, b.in_form, b.in_article)
        run = b.links >= LINKS
        while run and j < len(found) and found[j].links >= LINKS and (found[j].aside, found[j].in_form, found[j].in_article) == context:
            j += 1
        words = sum(x.words for x in found[i:j]) / (j - i)
        if judge((*context, has_article, words, b.links, *size(i - 1), *size(j), (j - i) * run)):
            kept += [x.text for x in found[i:j]]
        i = j
    return "\n".join(kept)


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars in place of the html; no shuffle."""
    rest = [f for f in df.schema if f.name not in (html, "text", "n_chars")]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(h) for h in part.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
            )

    return df.select(*[f.name for f in rest], html).mapInArrow(batches, schema)
