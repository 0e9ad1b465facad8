"""Main text of pages: flat text blocks with word count and link density of their neighbours, classified by a decision tree.

Markup is cut into blocks at block-level tags and line breaks. A block knows its words, the share of them in links, the same of the blocks
before and after, and whether it stands in an article or in parts that pages repeat. The tree is grown, at first use, on the
labelled blocks and pages below. Kept blocks are joined by one space; references are decoded; white space within a block is one space.

Parts that pages repeat are told by tags or by words of class, id and role. Such words don't mark main, an article, or elements that hold
one; articles within an article and those of class comment or reply stay marked. On pages without main and article, class words don't mark what holds
over half of the page's unlinked words either, unless they tell comments: that is a wrapper of the text.

Null and empty pages give an empty text. Repeated rows give equal rows; an empty table gives an empty table; other columns are ignored, whatever
their names. Pages are read once from start to end, very long ones too, in time that grows with their length. A tag that breaks off takes the
rest of the page; a quote that is never closed is no quote. Ties of a split go to the first feature and least bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import map_batches, table

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style title textarea noscript template iframe object svg math noframes xmp select button canvas audio video".split())
#: Elements that hold what a page repeats or asks for.
REPEATED_TAGS = set("nav header footer aside form menu dialog".split())
ARTICLE_TAGS = set("article main".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that tell such parts.
REPEATED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget cookie cookies consent notice popup modal comment comments disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe login signup search pagination pager toolbar skip contentinfo complementary".split()
)
#: Whole class words of articles that are comments of readers.
COMMENT_WORDS = set("comment comments reply replies".split())
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The end of a tag, or a quote that begins the value of an attribute.
STOP = re.compile(r"=\s*([\"'])|>")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_repeated", "in_article")
#: Labelled blocks: the features above, then 1 for main text. Made by hand from what pages usually hold.
LABELLED = (
    # words, link density, before: words, links, after: words, links, repeated part, article, main text
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0),
    (2, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0),
    (12, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0),
    (30, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0),
    (40, 0.0, 40, 0.0, 12, 0.0, 1, 1, 0),
    (6, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0),
    (25, 0.0, 30, 0.0, 25, 0.0, 1, 1, 0),
    (90, 0.0, 5, 0.0, 70, 0.0, 1, 0, 0),
    (3, 0.0, 2, 0.0, 2, 0.0, 1, 1, 0),
    (10, 0.0, 8, 0.0, 50, 0.0, 0, 1, 1),
    (1, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1),
    (2, 0.0, 60, 0.0, 12, 0.0, 0, 1, 1),
    (60, 0.0, 10, 0.0, 55, 0.0, 0, 1, 1),
    (45, 0.2, 60, 0.0, 30, 0.1, 0, 1, 1),
    (3, 1.0, 60, 0.0, 40, 0.0, 0, 1, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (15, 0.5, 30, 0.0, 20, 0.5, 0, 1, 1),
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1),
    (4, 0.0, 2, 0.0, 5, 1.0, 0, 1, 1),
    (3, 0.0, 4, 1.0, 6, 0.0, 0, 1, 1),
    (5, 1.0, 3, 0.0, 4, 0.0, 0, 1, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0),
    (7, 0.0, 1, 0.0, 0, 0.0, 0, 1, 1),
    (6, 0.0, 12, 0.0, 7, 0.3, 0, 1, 1),
    (9, 0.2, 1, 1.0, 4, 0.0, 0, 1, 1),
    (30, 0.8, 20, 0.9, 15, 1.0, 0, 1, 0),
    (1, 0.0, 100, 0.0, 3, 0.7, 0, 1, 1),
    (12, 0.0, 0, 0.0, 2, 0.0, 0, 1, 1),
    (80, 0.0, 70, 0.0, 90, 0.0, 0, 0, 1),
    (40, 0.05, 60, 0.0, 50, 0.1, 0, 0, 1),
    (25, 0.1, 80, 0.0, 60, 0.0, 0, 0, 1),
    (18, 0.0, 90, 0.0, 70, 0.0, 0, 0, 1),
    (12, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1),
    (30, 0.0, 0, 0.0, 45, 0.0, 0, 0, 1),
    (5, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0),
    (20, 0.9, 12, 0.8, 15, 1.0, 0, 0, 0),
    (14, 0.7, 60, 0.0, 3, 1.0, 0, 0, 0),
    (40, 0.6, 30, 0.7, 30, 0.8, 0, 0, 0),
    (3, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0),
    (6, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0),
    (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0),
)

#: Blocks of whole pages in order: words, link density, repeated part, article, main text. Made by hand as well; the neighbours' figures follow from the order.
LABELLED_PAGES = (
    # A report without article or main, its menu and its last lines unmarked.
    ((1, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0), (4, 0.0, 0, 0, 0), (6, 0.0, 0, 0, 1), (62, 0.0, 0, 0, 1), (45, 0.05, 0, 0, 1), (11, 0.0, 0, 0, 1), (70, 0.1, 0, 0, 1), (55, 0.0, 0, 0, 1), (7, 0.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0)),
    # Short paragraphs under headings, without article; a footer line ends the page.
    ((1, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (6, 0.0, 0, 0, 1), (14, 0.0, 0, 0, 1), (18, 0.0, 0, 0, 1), (12, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (16, 0.1, 0, 0, 1), (10, 0.0, 0, 0, 1), (22, 0.0, 0, 0, 1), (5, 0.0, 0, 0, 0)),
    # Headings before short paragraphs and lines of a few words between paragraphs.
    ((9, 0.0, 0, 0, 1), (90, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (8, 0.0, 0, 0, 1), (7, 0.0, 0, 0, 1), (30, 0.0, 0, 0, 1), (5, 0.0, 0, 0, 1), (13, 0.0, 0, 0, 1), (150, 0.02, 0, 0, 1), (3, 0.0, 0, 0, 0)),
    # A list of links before a long paragraph, one between paragraphs and one at the end.
    ((5, 1.0, 0, 0, 0), (6, 1.0, 0, 0, 0), (12, 0.9, 0, 0, 0), (80, 0.0, 0, 0, 1), (20, 0.8, 0, 0, 0), (65, 0.1, 0, 0, 1), (40, 0.2, 0, 0, 1), (9, 1.0, 0, 0, 0), (45, 0.9, 0, 0, 0), (25, 0.7, 0, 0, 0)),
    # One paragraph between links: the last and only block of text.
    ((2, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (120, 0.0, 0, 0, 1), (2, 1.0, 0, 0, 0), (3, 0.0, 0, 0, 0), (1, 1.0, 0, 0, 0)),
    # Buttons and notices of a few words, then links, no text at all.
    ((2, 0.0, 0, 0, 0), (3, 0.0, 0, 0, 0), (1, 0.0, 0, 0, 0), (4, 1.0, 0, 0, 0), (2, 0.0, 0, 0, 0), (6, 1.0, 0, 0, 0), (5, 0.0, 0, 0, 0), (7, 1.0, 0, 0, 0)),
    # An article with long blocks before short ones, a list of links to other pages at its end, a marked menu and footer about it.
    ((1, 1.0, 1, 0, 0), (2, 1.0, 1, 0, 0), (7, 0.0, 0, 1, 1), (3, 0.0, 0, 1, 1), (85, 0.0, 0, 1, 1), (4, 0.0, 0, 1, 1), (60, 0.3, 0, 1, 1), (2, 0.0, 0, 1, 1), (8, 1.0, 0, 1, 0), (6, 1.0, 0, 1, 0), (11, 1.0, 0, 1, 0), (7, 0.9, 0, 1, 0), (6, 0.0, 1, 0, 0)),
    # Lists of short links between plain paragraphs of an article, and linked lines alone between some with links in them.
    ((4, 0.0, 0, 1, 1), (30, 0.0, 0, 1, 1), (3, 1.0, 0, 1, 0), (2, 1.0, 0, 1, 0), (5, 1.0, 0, 1, 0), (45, 0.0, 0, 1, 1), (1, 1.0, 0, 1, 0), (4, 1.0, 0, 1, 0), (20, 0.0, 0, 1, 1), (12, 0.0, 0, 1, 1)),
    ((50, 0.1, 0, 1, 1), (5, 1.0, 0, 1, 1), (40, 0.2, 0, 1, 1), (9, 1.0, 0, 1, 1), (33, 0.1, 0, 1, 1), (2, 1.0, 0, 1, 1), (25, 0.3, 0, 1, 1)),
    # An article that begins with a list of its sections and has one of links between its paragraphs.
    ((5, 0.0, 0, 1, 1), (2, 1.0, 0, 1, 0), (4, 1.0, 0, 1, 0), (3, 1.0, 0, 1, 0), (30, 0.1, 0, 1, 1), (50, 0.0, 0, 1, 1), (6, 1.0, 0, 1, 0), (7, 0.8, 0, 1, 0), (9, 1.0, 0, 1, 0), (75, 0.0, 0, 1, 1), (1, 0.0, 0, 1, 1), (20, 0.4, 0, 1, 1)),
    # Pages that begin with their heading, or have it after links of one word.
    ((3, 0.0, 0, 0, 1), (70, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1)),
    ((1, 0.0, 0, 0, 1), (12, 0.0, 0, 0, 1), (15, 0.0, 0, 0, 1), (4, 0.0, 0, 0, 0)),
    ((1, 1.0, 0, 0, 0), (5, 0.0, 0, 0, 1), (60, 0.0, 0, 0, 1), (9, 0.0, 0, 0, 1), (2, 1.0, 0, 0, 0)),
    ((2, 1.0, 0, 0, 0), (1, 1.0, 0, 0, 0), (2, 0.0, 0, 0, 1), (14, 0.0, 0, 0, 1), (35, 0.0, 0, 0, 1)),
    # Headings of lists of links, after text and by themselves.
    ((50, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 0), (10, 1.0, 0, 0, 0), (16, 0.9, 0, 0, 0), (4, 0.0, 0, 0, 0), (13, 1.0, 0, 0, 0), (30, 0.8, 0, 0, 0)),
    ((2, 0.0, 0, 0, 0), (20, 1.0, 0, 0, 0), (25, 0.9, 0, 0, 0), (5, 0.0, 0, 0, 0), (9, 1.0, 0, 0, 0)),
    # Paragraphs of one short sentence under headings.
    ((3, 1.0, 0, 0, 0), (4, 0.0, 0, 0, 1), (9, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (10, 0.0, 0, 0, 1), (11, 0.1, 0, 0, 1), (5, 0.0, 0, 0, 1), (8, 0.0, 0, 0, 1), (9, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (10, 0.0, 0, 0, 1), (4, 0.0, 0, 0, 0), (1, 1.0, 0, 0, 0)),
    # Outside articles linked lines between paragraphs lead to other pages.
    ((90, 0.0, 0, 0, 1), (6, 1.0, 0, 0, 0), (75, 0.0, 0, 0, 1), (4, 1.0, 0, 0, 0), (50, 0.1, 0, 0, 1), (9, 0.9, 0, 0, 0), (3, 1.0, 0, 0, 0), (40, 0.0, 0, 0, 1), (7, 1.0, 0, 0, 0), (85, 0.0, 0, 0, 1)),
    # Links of many words in a row inside an article; a linked line alone between its paragraphs is text.
    ((40, 0.0, 0, 1, 1), (20, 1.0, 0, 1, 0), (18, 0.9, 0, 1, 0), (25, 1.0, 0, 1, 0), (60, 0.0, 0, 1, 1), (6, 1.0, 0, 1, 1), (35, 0.0, 0, 1, 1), (4, 1.0, 0, 1, 1), (12, 0.0, 0, 1, 1)),
)


def rows_of(page: tuple[tuple[float, ...], ...]) -> list[tuple[float, ...]]:
    """The labelled blocks of a page with their neighbours' figures, as in LABELLED."""
    none = (0, 0.0, 0, 0, 0)
    around = [none, *page, none]
    return [(*b[:2], *p[:2], *n[:2], *b[2:]) for p, b, n in zip(around, page, around[2:])]


LABELLED += tuple(r for page in LABELLED_PAGES for r in rows_of(page))


class Block:
    __slots__ = ("text", "words", "links", "repeated", "article")

    def __init__(self, text: str, words: int, links: float, repeated: int, article: int) -> None:
        self.text, self.words, self.links, self.repeated, self.article = text, words, links, repeated, article


class Pieces:
    """A page's tags one after another, and the text between them. Each character is passed over a fixed number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.end = html, len(html)
        self.open_quotes: set[str] = set()  # quotes of which there are no more further on
        self.lower: str | None = None

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at this place ends: the place of its >, or the page's end."""
        while m := STOP.search(self.html, at):
            at = m.end()
            if not m[1]:
                return m.start()
            if m[1] not in self.open_quotes:
                close = self.html.find(m[1], at)
                if close < 0:
                    self.open_quotes.add(m[1])
                else:
                    at = close + 1
        return self.end

    def after_raw(self, name: str, at: int) -> int:
        """Where the closing tag of an element without text of its own begins, or the page's end."""
        if self.lower is None:
            self.lower = ascii_lower(self.html)
        stop = self.lower.find(f"</{name}", at)
        return self.end if stop < 0 else stop

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """(text, False, "") or ("/" and name or name, True, attributes)."""
        html, at, find = self.html, 0, self.html.find
        while at < self.end:
            start = find("<", at)
            if start < 0:
                yield html[at:], False, ""
                return
            if start > at:
                yield html[at:start], False, ""
            if html.startswith("<!--", start):
                stop = find("-->", start + 4)
                at = self.end if stop < 0 else stop + 3
            elif m := NAME.match(html, start + 1):
                stop = self.tag_end(m.end())
                at = min(stop + 1, self.end)
                name = m[0].lower()
                yield name, True, html[m.end() : stop]
                if name in RAW and html[stop - 1] != "/":
                    at = self.after_raw(name, at)
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                stop = find(">", start + 2)
                at = self.end if stop < 0 else stop + 1
            else:
                yield "<", False, ""
                at = start + 1


class Marked:
    """An element that words of class, id or role mark, in the marked element about it. holds: an article stands in it, or it wraps the page's text."""

    __slots__ = ("about", "comment", "holds", "plain")

    def __init__(self, about: Marked | None, comment: bool) -> None:
        self.about, self.comment, self.holds, self.plain = about, comment, False, 0


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, without those that have no word."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # Open elements: name, in a repeated part by its tags, in an article, the nearest element marked by words.
    stack: list[tuple[str, int, int, Marked | None]] = []
    open_names: Counter[str] = Counter()
    marked_by: list[Marked | None] = []  # of each block
    marked: list[Marked] = []  # those about come before those within
    in_link = any_article = False

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len(unescape("".join(t for t, x in parts if x)).split())
                words = text.count(" ") + 1
                _, repeated, article, mark = stack[-1] if stack else ("", 0, 0, None)
                out.append(Block(text, words, min(1.0, linked / words), repeated, article))
                marked_by.append(mark)
            parts.clear()

    for name, is_tag, attributes in Pieces(html):
        if not is_tag:
            parts.append((name, in_link))
            continue
        closing = name[0] == "/"
        name = name.lstrip("/")
        if name in INLINE:
            if name == "a":
                in_link = not closing
            continue
        if name in RAW:
            continue
        close()
        if name in VOID or attributes.endswith("/"):
            continue
        if closing:
            in_link = False
            if open_names[name]:
                while True:
                    gone = stack.pop()[0]
                    open_names[gone] -= 1
                    if gone == name:
                        break
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            open_names["p"] -= 1
        marks = " ".join(x or y or z for x, y, z in MARKS.findall(attributes)).lower() if attributes else ""
        comment = bool(marks) and not COMMENT_WORDS.isdisjoint(marks.split())
        _, repeated, article, mark = stack[-1] if stack else ("", 0, 0, None)
        if name not in ("html", "body"):
            repeated = int(repeated or name in REPEATED_TAGS)
            if marks and not REPEATED_WORDS.isdisjoint(re.split(r"[\s_-]+", marks)):
                mark = Marked(mark, comment or not COMMENT_WORDS.isdisjoint(re.split(r"[\s_-]+", marks)))
                marked.append(mark)
        if name in ARTICLE_TAGS:
            if not open_names["article"] and not (name == "article" and comment):
                any_article, x = True, mark
                while x and not x.holds:
                    x.holds = True
                    x = x.about
        stack.append((name, repeated, int(article or name in ARTICLE_TAGS), mark))
        open_names[name] += 1
    close()
    if not any_article:
        wrap(out, marked_by, marked)
    for b, mark in zip(out, marked_by, strict=True):
        b.repeated = int(b.repeated or (mark is not None and not mark.holds))
    return out


def wrap(found: list[Block], marked_by: list[Marked | None], marked: list[Marked]) -> None:
    """Tells the marked elements that hold over half of the words that aren't linked or in parts repeated by their tags."""
    total = 0
    for b, mark in zip(found, marked_by, strict=True):
        if not b.repeated:
            plain = b.words - round(b.links * b.words)
            total += plain
            if mark:
                mark.plain += plain
    for x in reversed(marked):
        if x.about:
            x.about.plain += x.plain
    for x in marked:
        x.holds = not x.comment and 2 * x.plain > total and (x.about is None or x.about.holds)


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def vectors(found: list[Block]) -> list[tuple[float, ...]]:
    none = Block("", 0, 0.0, 0, 0)
    around = [none, *found, none]
    return [(b.words, b.links, p.words, p.links, n.words, n.links, b.repeated, b.article) for p, b, n in zip(around, found, around[2:])]


def grow(rows: list[tuple[float, ...]], depth: int = 6) -> tuple | int:
    """A decision tree by Gini impurity: (feature, bound, tree up to the bound, tree above) or a class."""
    yes = sum(r[-1] for r in rows)
    if depth == 0 or yes in (0, len(rows)):
        return int(2 * yes > len(rows))
    gini = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            bound = (a + b) / 2
            low, high = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            cost = gini(low) + gini(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, bound, low, high)
    if best is None:
        return int(2 * yes > len(rows))
    _, f, bound, low, high = best
    return f, bound, grow(low, depth - 1), grow(high, depth - 1)


def decide(tree: tuple | int, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree: tuple | int) -> str:
    found = blocks(html or "")
    return " ".join(b.text for b, v in zip(found, vectors(found), strict=True) if decide(tree, v))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = grow(list(LABELLED))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], schema=schema)

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
