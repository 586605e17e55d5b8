"""Main text of web pages by two passes over their blocks.

A page is read once, tag by tag, into blocks: stretches of text between block-level tags,
with the share of their text that stands in links and the kind of place they stand in.

Pass one decides what it can: blocks in menus, page headers, footers, sidebars, notices,
adverts, forms and reader comments are boilerplate, and so are those made of links.  Of the
others, long ones with enough stop words are main text, and those with few are boilerplate;
inside an article they stay open, as short blocks do.  Stop words are English, German, French
and Spanish; on a page without any block that has enough of them, long blocks with the signs
that end a sentence count instead.  In pass two each open block takes the label of its nearest
decided neighbours, looked for on both sides within its own part of the page.  If they differ
the nearer one counts, and with none the block is not text; but an article's own block is
dropped only between boilerplate on both sides.

Forms and elements named as boilerplate go whole, unless one holds at least half of the
page's main text and no article or main element has text beside it: then it wraps the page.  An article within an article is a reader's comment,
unless the outer one has no main text of its own, as with chapters.

Scripts, styles and other content that is not shown never become blocks.  If the articles (or
else the main element, or both) hold at least half of the main text, blocks elsewhere stay
only if pass one alone finds them main text, as with a lead before the article.  White space is collapsed,
blocks are joined by an empty line; nothing else is cut.  A null, empty or broken page gives
the text that can be read, an empty one if none.  Unclosed tags end with their parents; an unclosed
button or the like hides nothing behind the next block.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import key_text

# Element names, words in class and id attributes, and stop words.
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas video audio map title textarea select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = BLOCKS - {"caption", "thead", "tbody", "tfoot", "tr", "td", "th", "legend", "summary"}
PLACES_OFF = frozenset("nav aside footer menu dialog head".split())
RAW = frozenset("script style title textarea iframe".split())  # their content is no markup
ROLES_OFF = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES_OFF = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay comment comments commentlist disqus reply replies respond related recommended recommendations share "
    "sharing social subscribe subscription newsletter signup login search form pagination pager copyright disclaimer toolbar paywall".split())
NAMES_HEADER = frozenset(["header", "topbar", "site-header", "pageheader"])
LAYOUT_WORDS = frozenset(["has", "with", "no", "without", "is", "not"])
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist ja mit nach "
    "nicht noch nur oder sich sie sind so und um von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses "
    "son sont sur un une vous y "
    "al como con del el ella en es esta este ha la las lo los más mi muy no o para pero por que se ser si sin su sus también un una unos y ya yo".split())

EDGES = string.punctuation + "«»„“”‘’…–—"
SHORT, LONG = 70, 200
STOPS_HIGH, STOPS_LOW = 0.30, 0.20
LINKS_PAGE, LINKS_ARTICLE = 0.33, 0.5

GOOD, BAD, NEAR_GOOD, OPEN = "good", "bad", "near good", "open"
ARTICLE, MAIN, PAGE, OFF = "article", "main", "page", "off"
#: Content of a form or of an element named as boilerplate, and of an article within an article: what stands there decides.
DOUBTED, INNER = "doubted", "inner"
ENDS = re.compile(r"[.!?…。！？؟।]")


@dataclass
class Block:
    text: str
    linked: int
    place: str
    doubt: int = 0  # number of the outermost doubted element it stands in
    inner: bool = False  # whether it stands in an article within an article


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id (those after a layout word left out), the role, and whether it is hidden."""
    found, role, hidden = set(), "", bool(re.search(r"(?<![\w-])hidden(?![\w-])", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "", attributes)))
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", value).lower())
            found.update(p for i, p in enumerate(parts) if p and not (i and parts[i - 1] in LAYOUT_WORDS))
        elif name == "role":
            role = value.strip().lower()
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return found, role, hidden


def _place(tag: str, attributes: str, around: str) -> str:
    """Where the content of an element stands, given where the element stands; ``DOUBTED`` and ``INNER`` add to that."""
    if around == OFF or tag in PLACES_OFF:
        return OFF
    if tag in ("html", "body"):
        return around
    names, role, hidden = _names(attributes) if attributes.strip() else (set(), "", False)
    inside = around in (ARTICLE, MAIN)
    if hidden or role in ROLES_OFF or (not inside and (tag == "header" or names & NAMES_HEADER)):
        return OFF
    if tag == "form" or names & NAMES_OFF:
        return DOUBTED
    if tag == "article" or role == "article":
        return INNER if around == ARTICLE else ARTICLE
    if tag == "main" or role == "main":
        return around if around == ARTICLE else MAIN
    return around


class Reader:
    """Turns one page into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str, int, bool]] = []  # open block elements: tag, and place, doubt and inner of their content
        self.doubts = 0
        self.opened: Counter[str] = Counter()  # how many of each are open
        self.parts: list[str] = []
        self.linked = 0
        self.link = False
        self.breaks = 0
        self.skipped: list[str] = []  # open inline elements within an inline advert, share bar or the like

    def place(self) -> str:
        return self.open[-1][1] if self.open else PAGE

    def text(self, raw: str) -> None:
        if not raw or self.skipped:
            return
        plain = html.unescape(raw) if "&" in raw else raw
        self.parts.append(plain)
        if not plain.isspace():
            self.breaks = 0
            if self.link:
                self.linked += len("".join(plain.split()))

    def end_block(self) -> None:
        joined = " ".join("".join(self.parts).split())
        if joined:
            self.blocks.append(Block(joined, self.linked, *(self.open[-1][1:] if self.open else (PAGE,))))
        self.parts, self.linked, self.breaks, self.skipped = [], 0, 0, []

    def close(self, upto: int) -> None:
        """Close open elements down to the one at ``upto``."""
        while len(self.open) > upto:
            self.opened[self.open.pop()[0]] -= 1

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
        elif tag in BLOCKS:
            self.end_block()
            for closed in (("p",) if tag in CLOSES_PARAGRAPH else ()) + ((tag,) if tag == "li" else ("head",) if tag == "body" else ()):
                if self.open and self.open[-1][0] == closed:
                    self.close(len(self.open) - 1)
            if tag not in VOID:
                around, doubt, inner = self.open[-1][1:] if self.open else (PAGE, 0, False)
                place = _place(tag, attributes, around)
                if place == DOUBTED:
                    if not doubt:
                        self.doubts += 1
                    place, doubt = around, doubt or self.doubts
                elif place == INNER:
                    place, inner = ARTICLE, True
                self.open.append((tag, place, doubt, inner))
                self.opened[tag] += 1
        elif tag not in VOID and (self.skipped or (attributes.strip() and self.place() != OFF and _place(tag, attributes, self.place()) in (OFF, DOUBTED))):
            self.skipped.append(tag)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag in BLOCKS:
            self.end_block()
            if self.opened[tag]:
                last = len(self.open) - 1
                while self.open[last][0] != tag:  # every element passed is closed, so each is passed once
                    last -= 1
                self.close(last)
                self.link = False
        elif tag in self.skipped:
            while self.skipped.pop() != tag:
                pass

    def behind(self, tag: str, attributes: str, page: str, at: int) -> int:
        """Where reading goes on after an element that is not shown, whose content starts ``at``."""
        if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
            return at
        closing = _ending(tag).search(page, at)
        if tag in RAW:
            return closing.end() if closing else len(page)
        # It ends with its parent, and before the next of its kind where these do not stand in each other.
        parent = _ending(self.open[-1][0]).search(page, at) if self.open else None
        bounds = [parent.start()] if parent else []
        if tag in ("button", "select") and (again := _starting(tag).search(page, at, closing.start() if closing else len(page))):
            bounds.append(again.start())
        if closing and all(closing.start() < b for b in bounds):
            return closing.end()
        block = _BLOCK_TAG.search(page, at)
        return min([*bounds, block.start()] if block else bounds, default=at)

    def read(self, page: str) -> list[Block]:
        at = 0
        while (m := TOKEN.search(page, at)) is not None:
            self.text(page[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.end(tag)
            elif tag in UNSEEN:
                at = self.behind(tag, m[3] or m[6] or "", page, at)
            else:
                self.start(tag, m[3] or m[6] or "")
        self.text(page[at:])
        self.end_block()
        return self.blocks


@cache
def _ending(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![a-zA-Z0-9-])[^>]*>?", re.I)


@cache
def _starting(tag: str) -> re.Pattern:
    return re.compile(rf"<{tag}(?![a-zA-Z0-9-])", re.I)


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![a-zA-Z0-9-])", re.I)


def first_pass(block: Block, spoken: bool = True) -> str:
    """A label from the block alone; ``spoken`` if the page is in a language whose stop words are known."""
    size = len(block.text)
    if not spoken and size > 20 * (1 + block.text.count(" ")):
        size *= 2  # words are not spaced, and signs stand for more
    links = block.linked / max(1, size - block.text.count(" "))
    inside = block.place in (ARTICLE, MAIN)
    if block.place == OFF or links > (LINKS_ARTICLE if inside else LINKS_PAGE):
        return BAD
    if size < SHORT:
        return BAD if block.linked and not inside else OPEN
    if not spoken:
        return OPEN if not ENDS.search(block.text) and inside else BAD if not ENDS.search(block.text) else GOOD if size > LONG else NEAR_GOOD
    words = block.text.lower().split()
    stops = sum(w.strip(EDGES) in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH:
        return GOOD if size > LONG else NEAR_GOOD
    if stops >= STOPS_LOW:
        return NEAR_GOOD
    return OPEN if inside else BAD


def second_pass(places: list[str], labels: list[str]) -> list[bool]:
    """Whether each block is main text: open ones inherit from the nearest decided ones of their part.

    Blocks that stand off the text belong to the part they interrupt only as what they are,
    so they are no neighbours of blocks inside an article.
    """
    n = len(labels)

    def nearest(decided: frozenset[str], step: int) -> list[tuple[int, str] | None]:
        found: list[tuple[int, str] | None] = [None] * n
        last: dict[str, tuple[int, str]] = {}
        for i in range(n) if step > 0 else range(n - 1, -1, -1):
            inside = places[i] in (ARTICLE, MAIN)
            part = places[i] if inside else PAGE
            if part in last:
                found[i] = last[part]
            if labels[i] in decided:
                last[part] = (i, labels[i])
        return found

    before, after = nearest(frozenset([GOOD, BAD]), 1), nearest(frozenset([GOOD, BAD]), -1)
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        sides = [x for x in (before[i], after[i]) if x]
        kinds = {k for _, k in sides}
        if places[i] in (ARTICLE, MAIN):  # boilerplate on both sides is needed to doubt an article's own block
            out.append(len(sides) < 2 or GOOD in kinds)
        elif not sides:
            out.append(label == NEAR_GOOD)
        elif len(kinds) == 1:
            out.append(kinds == {GOOD})
        else:
            gaps = {k: abs(i - at) for at, k in sides}
            out.append(label == NEAR_GOOD or gaps[GOOD] < gaps[BAD])
    return out


def _main_places(good: list[tuple[Block, str]]) -> frozenset[str]:
    """The places of the main part: those of articles, or of main elements, if they hold most of the good text; else all."""
    texts = Counter({place: 0 for place in (ARTICLE, MAIN, PAGE)})
    for block, label in good:
        if label != OPEN:
            texts[block.place] += len(block.text)
    if not texts.total():  # short blocks only
        texts.update(b.place for b, _ in good)
    for places in (frozenset([ARTICLE]), frozenset([MAIN]), frozenset([ARTICLE, MAIN])):
        if 2 * sum(texts[p] for p in places) >= texts.total():
            return places
    return frozenset([ARTICLE, MAIN, PAGE])


def _settle(blocks: list[Block], labels: list[str]) -> None:
    """Put the blocks of doubted elements and of inner articles off the text, unless they hold it.

    A doubted element holds the text if at least half of what pass one finds good stands in it
    and no article or main element has text beside it.
    """
    texts: Counter[int] = Counter()
    for b, label in zip(blocks, labels):
        if label in (GOOD, NEAR_GOOD):
            texts[b.doubt] += len(b.text)
    beside = any(b.place in (ARTICLE, MAIN) and not b.doubt for b in blocks)
    chapters = not any(label in (GOOD, NEAR_GOOD) and b.place == ARTICLE and not b.inner and not b.doubt for b, label in zip(blocks, labels))
    for b in blocks:
        if (b.doubt and (beside or 2 * texts[b.doubt] < max(1, texts.total()))) or (b.inner and not chapters):
            b.place = OFF


def main_blocks(page: str | None) -> list[str]:
    """The blocks of a page's main text, in page order."""
    blocks = Reader().read(page) if page else []
    own = [first_pass(b) for b in blocks]
    spoken = not {GOOD, NEAR_GOOD}.isdisjoint(own)
    _settle(blocks, own if spoken else [first_pass(b, False) for b in blocks])
    labels = own = [first_pass(b, spoken) for b in blocks]
    if GOOD not in labels:  # a page of middling blocks only: the best there is
        labels = [GOOD if label == NEAR_GOOD else label for label in labels]
    kept = second_pass([b.place for b in blocks], labels)
    good = [(b, label) for b, label, keep in zip(blocks, own, kept) if keep]
    places = _main_places(good)
    return [b.text for b, label in good if label == GOOD or b.place in places]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) for each row of ``pages``."""
    schema = T.StructType([
        T.StructField(key, T.StringType()), T.StructField(url, T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch["page"]]
            yield pd.DataFrame({key: batch["key"], url: batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(key_text(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")).mapInPandas(extracted, schema)
    return rows.withColumn(key, F.col(key).cast(pages.schema[key].dataType))
