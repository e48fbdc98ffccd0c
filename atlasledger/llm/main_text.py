"""Main text of web pages by two-pass block rules.

Pass 1 classifies each block of text by its link density, length and share of stop words; blocks in
parts of the page that say what they are (navigation, forms, adverts, comments, ...) are out at once.
Where none of a page's blocks has stop words, its language is not one whose stop words are known, and
length and link density decide alone.
Pass 2 gives each undecided block, most of them short, the label of its nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from atlasledger.session import small_batches

#: Characters under which a block is too short to judge, and words of which it has any stop word.
SHORT, LONG = 70, 200
#: Share of link characters from which a block is navigation.
LINKS = 0.33
#: Shares of stop words: a long block with the first is good, any with less than the second is not text.
STOP_HIGH, STOP_LOW = 0.10, 0.03
#: Share of all text outside excluded parts that the page's own article must hold to rule out the rest.
ARTICLE_SHARE = 1 / 3

# fixed values: stop words of four languages; what element names and class or id words mean
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with at be by this from have or not but an a you "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es aus er hat sie nach bei "
    "de la le et les un une du que est pour dans qui par sur au pas plus ne se avec "
    "el en y los del las por para con no su al lo como más una".split()
)
_RAW = frozenset("script style noscript template textarea title iframe".split())  # without an end, up to the page's
_SKIPPED = frozenset("select button svg math object canvas audio video head".split())  # without an end, nothing
_OUT = frozenset("nav header footer aside form menu dialog label fieldset legend".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|"
    r"subscri\w+|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|share|sharing|social|"
    r"related|recommended|comments?|comment-?list|disqus|replies|reply|respond|popup|modal|overlay|login|signup|search|"
    r"pagination|pager|toolbar|copyright|legal|disclaimer|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: what begins with ``<``; quoted values may hold ``>``
_TAG = re.compile(r"<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.I)
_TAG_BEGINS = re.compile(r"</?[a-z]", re.I)
_MARK = re.compile(r"[>\"']")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_OWN_HEADER = re.compile(r"\b\w*-?header\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"\w+")
GOOD, BAD, OPEN = "good", "bad", None


class Block(NamedTuple):
    text: str
    links: int  # characters in links
    article: bool  # within the page's article or main part
    heading: bool


def _is_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _OUT:  # an article's own header holds its title
        return not (tag == "header" and in_article)
    if in_article:
        attributes = _OWN_HEADER.sub("", attributes)
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(_OUT_WORDS.search(next(filter(None, named), "")) for named in _NAMED.findall(attributes))


class _Page:
    """The tokens of a page, in time that grows with its length whatever it holds.

    A tag that is never closed is text. Finding that out takes a scan to the page's end, so the marks
    that such a scan met outside quotes are remembered: another that meets one of them fails too.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")  # no tag ends behind it
        self._endless: set[str] = set()  # elements of which no end follows
        self._dead: set[int] = set()
        self._mark = -1

    def _tag(self, at: int) -> re.Match[str] | None:
        if self._dead:
            if self._mark < at:
                found = _MARK.search(self.page, at)
                self._mark = found.start() if found else len(self.page)
            if self._mark in self._dead:
                return None
        tag = _TAG.match(self.page, at)
        if tag is None and _TAG_BEGINS.match(self.page, at):
            while (found := _MARK.search(self.page, at)) and found.start() not in self._dead:
                self._dead.add(found.start())
                at = self.page.find(found[0], found.end()) + 1
                if not at:
                    break
        return tag

    def _end(self, name: str, at: int) -> int | None:
        """Where the element that begins before ``at`` ends."""
        if name in self._endless:
            return None
        found = _ENDS[name].search(self.page, at)
        if found is None:
            self._endless.add(name)
        return found and found.end()

    def tokens(self) -> Iterator[tuple[str, str, str, str]]:
        """``text, slash, element, attributes``; comments, skipped elements and the like are empty texts."""
        page, at = self.page, 0
        while at < len(page):
            if page[at] != "<":
                to = page.find("<", at)
                to = len(page) if to < 0 else to
                yield page[at:to], "", "", ""
                at = to
            elif page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                yield "", "", "", ""
                at = len(page) if to < 0 else to + 3
            elif at < self.last and (tag := self._tag(at)):
                name = tag[2].lower()
                at = tag.end()
                if not tag[1] and (name in _RAW or name in _SKIPPED):
                    end = self._end(name, at)
                    if end is not None or name in _RAW:
                        yield "", "", "", ""
                        at = len(page) if end is None else end
                        continue
                yield "", tag[1], name, tag[3]
            elif at < self.last and page[at + 1] in "!?/":
                yield "", "", "", ""
                at = page.find(">", at) + 1
            else:
                yield "<", "", "", ""
                at += 1


_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | _SKIPPED}


def _unescaped(text: str) -> str:
    """Character references as characters; numbers that no character can have as U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text) if "&" in text else text


def blocks(page: str) -> Iterator[Block]:
    """Blocks of text outside excluded parts, in page order; tags need not be closed or nested well."""
    stack: list[tuple[str, bool, bool]] = []  # element, out, within an article
    open_: Counter[str] = Counter()  # how often an element is in the stack
    parts: list[str] = []
    links = 0
    linked = heading = False

    def ended() -> Iterator[Block]:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                yield Block(text, links, bool(stack) and stack[-1][2], heading)
        parts.clear()
        links = 0

    for text, slash, tag, attributes in _Page(page).tokens():
        if text:
            if not stack or not stack[-1][1]:
                text = _unescaped(text)
                parts.append(text)
                links += len(text) if linked else 0
            continue
        if not tag:
            parts.append(" ")
            continue
        if tag in _BLOCK or tag == "br" and not slash:
            if tag == "br":
                parts.append(" ")
                continue
            yield from ended()
            linked = False
        if slash:
            if tag == "a":
                linked = False
            heading = False if tag[0] == "h" and tag[1:].isdigit() else heading
            while open_[tag]:  # up to the element that ends
                last = stack.pop()[0]
                open_[last] -= 1
                if last == tag:
                    break
            continue
        if tag in _BLOCK and stack and stack[-1][0] == "p":
            open_[stack.pop()[0]] -= 1  # a paragraph ends where a block begins
        if tag == "a":
            linked = True
        if tag in _VOID:
            continue
        if tag[0] == "h" and tag[1:].isdigit():
            heading = True
        out, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        article = article or tag in ("article", "main")
        if tag in _BLOCK or tag == "span":
            out_now = out or _is_out(tag, attributes, article)
            if out_now and not out:
                yield from ended()
            stack.append((tag, out_now, article))
            open_[tag] += 1
    yield from ended()


def classified(found: list[Block]) -> list[str | None]:
    """Pass 1: by the block alone."""
    total = sum(len(b.text) for b in found)
    own = sum(len(b.text) for b in found if b.article)
    bounded = own > 0 and own >= ARTICLE_SHARE * total
    out: list[str | None] = []
    judged: list[tuple[int, float]] = []  # blocks that stop words decide on, with their share
    for k, b in enumerate(found):
        size = len(b.text)
        if bounded and not b.article or b.links > LINKS * size:
            out.append(BAD)
        elif size < SHORT or b.heading:
            out.append(BAD if b.links and not b.article else OPEN)
        else:
            out.append(OPEN)
            words = _WORD.findall(b.text.lower())
            judged.append((k, sum(w in STOP_WORDS for w in words) / max(1, len(words))))
    known = any(stop >= STOP_LOW for _, stop in judged)
    for k, stop in judged:
        b = found[k]
        if stop >= STOP_HIGH or not known and not b.article:
            out[k] = GOOD if len(b.text) >= LONG or b.article else OPEN
        elif stop < STOP_LOW and not b.article:
            out[k] = BAD
    return out


def settled(labels: list[str | None], found: list[Block]) -> list[bool]:
    """Pass 2: each open block takes its nearest decided neighbour's label, a good one's at a tie.

    Neighbours in the same part (in or out of the article) come first. An article with no decided
    block is kept, and so is a page with none: then nothing speaks against them.
    """
    out = [label == GOOD for label in labels]

    def fill(own: list[int]) -> bool:
        if all(labels[k] is None for k in own):
            return False
        before, last = {}, None
        for k in own:
            last = k if labels[k] is not None else last
            before[k] = last
        last = None
        for k in reversed(own):
            last = k if labels[k] is not None else last
            if labels[k] is None:
                near = [j for j in (before[k], last) if j is not None]
                least = min(abs(j - k) for j in near)
                out[k] = any(labels[j] == GOOD for j in near if abs(j - k) == least)
        return True

    every = list(range(len(labels)))
    inside = [k for k in every if found[k].article]
    outside = [k for k in every if not found[k].article]
    if not fill(inside):  # the page calls it its article, and nothing speaks against that
        for k in inside:
            out[k] = True
    if not fill(outside) and not fill(every):
        return [True] * len(labels)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null or where there is none."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, settled(classified(found), found), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``row`` (all its columns but the page itself, as a struct, so that no
    names can clash), ``text`` and ``n_chars``, its code points.

    Character references are decoded, white space within a block becomes one space, and blocks are
    joined by one. Null and empty pages have an empty text. Rows stand for themselves: repeated ones
    come out repeatedly. Each page is read whole, in one pass, without a shuffle.
    """
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    rows = small_batches(pages).select(F.struct(*rest).alias("row"), F.col(f"`{html_col}`").cast("string").alias("page"))
    schema = StructType([rows.schema["row"]]).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py()) for p in part.column(1)]
                yield pa.record_batch(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["row", "text", "n_chars"],
                )

    return rows.mapInArrow(run, schema)
