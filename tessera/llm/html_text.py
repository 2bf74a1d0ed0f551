"""Main text of HTML pages by two passes of block rules.

A page is read once, left to right, into blocks. Elements that never hold an article (navigation, footers, forms,
hidden parts) and elements marked by a class, id or role of such a name are outside. Pass one decides the blocks that
are clear: by link density, and by length together with the share of stop words. Pass two lets each block that
stayed open, most of them short, take the label of the nearest decided blocks: that of both sides where they agree,
else that of the nearer one (of two as near, the good one). The borders of an article element count as decided
neighbours of the blocks inside it.

Lengths are in UTF-8 bytes, so a language that writes a word in one or two characters isn't taken for short blocks.
On a page that hardly has any of the stop words, its language is taken to be another one: length and link density
then decide alone. On a page where the marks leave nothing, they count for nothing.

Defined results: null and empty pages have an empty text; text outside any element is a block; broken markup
(unclosed elements and quotes, stray end tags, a page cut anywhere) is read as far as it goes: a tag without an end
is dropped with what follows it, an unclosed quote ends with its tag; pages of any length are read whole, in time
that grows with their length; repeated rows give equal rows; further columns of ``pages`` are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can for from had has have he her his how i if in is it its may more most no not of on one or our out so some such than that the their then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été être "
    "al como con de del e el ella en entre era es esta este ha hay la las lo los más me mi muy no o para pero por que se si sin sobre son su sus también un una y ya".split()
)
#: Elements whose content is no text of the page, to their end tag or the end of the page ...
RAW = frozenset(("script", "style"))
#: ... or, where there is no end tag, to the next tag.
HEAD = frozenset(("title", "textarea"))
#: Elements that never hold the article.
OUTSIDE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "header", "noscript", "template"))
#: Elements that hold it.
INSIDE = frozenset(("article", "main"))
#: Class, id and role values that tell the same, and words that such a value may be joined to by a hyphen or underscore.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
BESIDE = frozenset("a area bar bottom box block button buttons card container global icons inner item items left links list main outer page panel policy posts primary right row secondary section site thread top unit wrap wrapper".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead tr ul button".split())
_SHORT = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr td th thead tbody tfoot option hr html body".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE = re.compile(r"=\s*")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW | HEAD}


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Where each tag begins and ends, its name, its attributes, and whether it is an end tag; the name is empty for
    comments, declarations and elements that are no text. What is searched for in vain is not searched for again."""
    at, size, absent = 0, len(page), set()

    def find(what: str, start: int) -> int:
        place = -1 if what in absent else page.find(what, start)
        if place < 0:
            absent.add(what)
        return place

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = find("-->", at + 1)
            at = size if end < 0 else end + 3
            yield start, at, "", "", False
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if not name:
            if page.startswith(("!", "?", "/"), at):
                end = find(">", at)
                at = size if end < 0 else end + 1
                yield start, at, "", "", False
            continue
        here, end = name.end(), find(">", name.end())
        while end >= 0 and (sign := page.find("=", here, end)) >= 0:  # a quote after this sign may hold the next >
            here = _VALUE.match(page, sign).end()
            if page[here : here + 1] in ('"', "'") and (close := find(page[here], here + 1)) >= 0:
                here = close + 1
                end = find(">", here) if here > end else end
        at = size if end < 0 else end + 1
        tag = name[0].lower()
        if not closing and tag in _ENDS and end >= 0 and not page.endswith("/", start, end):
            close = None if tag in absent else _ENDS[tag].search(page, at)
            if close:
                end = find(">", close.end())
                at = size if end < 0 else end + 1
            else:
                absent.add(tag)
                at = size if tag in RAW else (page.find("<", at) + 1 or size + 1) - 1
            tag = ""
        yield start, at, tag, "" if end < 0 or closing or not tag else page[name.end() : end], closing


def is_mark(value: str) -> bool:
    """Whether a class, id or role names a part outside: a mark, or several words of which one is and no other tells otherwise."""
    parts = value.lower().replace("_", "-").strip("-").split("-")
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in BESIDE or p.isdigit() for p in parts)


def read_attributes(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether a name marks it as outside, and whether it is marked by nothing but ``header``."""
    hidden, marks = False, set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role"):
            marks |= {v.lower() for v in html.unescape(value).split() if is_mark(v)}
        elif name == "hidden":
            hidden = hidden or value.lower() not in ("false", "until-found")
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "style":
            style = "".join(value.lower().split())
            hidden = hidden or "display:none" in style or "visibility:hidden" in style
    return hidden, bool(marks), marks == {"header"}


@dataclass
class Block:
    text: str
    size: int  # bytes
    linked: int  # bytes inside links
    outside: bool
    marked: bool  # outside by a mark alone
    inside: bool
    article: int  # number of the article element, 0 for none
    good: bool | None = None


@dataclass
class Rules:
    """Limits of pass one: lengths in bytes, densities as shares."""

    most_linked: float = 0.5
    short: int = 70
    long: int = 200
    few_stop_words: float = 0.08
    many_stop_words: float = 0.25
    main_share: float = 0.2
    no_stop_words: float = 0.01


@dataclass
class _Reader:
    """What has been read so far. The stack holds tags with whether they are outside, outside by a mark, inside, and in which article."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, bool, bool, int]] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)  # where in the stack each tag is
    parts: list[str] = field(default_factory=list)
    link: bool = False
    linked: int = 0
    hidden: bool = False
    marked: bool = False
    articles: int = 0
    breaks: int = 0

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if raw.strip():
                self.breaks = 0
                if self.link:
                    self.linked += len(raw.strip().encode("utf-8", "replace"))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, outside, marked, inside, article = self.stack[-1] if self.stack else ("", False, False, False, 0)
                self.blocks.append(Block(text, len(text.encode("utf-8", "replace")), self.linked, outside or self.hidden, marked or self.marked, inside, article))
            self.parts = []
        self.linked, self.breaks = 0, 0

    def opened(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.breaks += 1
            self.flush() if self.breaks > 1 else self.parts.append("\n")
        if tag not in _BLOCKS:
            return
        self.flush()
        self.link = False
        hidden, mark, header = read_attributes(attributes) if attributes and tag not in ("html", "body") else (False, False, False)
        if tag in _SHORT:
            self.hidden, self.marked = hidden, mark
            return
        self.hidden = self.marked = False
        _, outside, marked, inside, article = self.stack[-1] if self.stack else ("", False, False, False, 0)
        if tag in INSIDE:
            if tag == "article" and article and self.places.get("article"):
                outside = True  # an article within an article is a comment on it
            elif not outside:
                marked = marked and tag == "article"
                self.articles += 1
                inside, article = True, self.articles
        elif tag in OUTSIDE and not (tag == "header" and inside):
            outside = True
        outside, marked = outside or hidden, marked or mark and not (header and inside)
        if not attributes.rstrip().endswith("/"):
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, outside, marked, inside, article))

    def closed(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag not in _BLOCKS:
            return
        self.flush()
        self.hidden = self.marked = False
        if tag in _SHORT:
            return
        last = lambda t: (self.places.get(t) or [-1])[-1]
        if last(tag) < 0 or tag not in INSIDE and last(tag) < max(map(last, INSIDE)):
            return  # it was never opened, or not within the article that is open
        keep = last(tag)
        for t, *_ in self.stack[keep:]:
            self.places[t].pop()
        del self.stack[keep:]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, undecided."""
    reader, at = _Reader(), 0
    for start, end, tag, attributes, closing in tags(page):
        reader.text(page[at:start])
        at = end
        if tag:
            reader.closed(tag) if closing else reader.opened(tag, attributes)
    reader.text(page[at:])
    reader.flush()
    return reader.blocks


def stop_words(text: str) -> tuple[int, int]:
    """How many of a text's words are stop words, and how many words it has."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'*#$%&") in STOP_WORDS for w in words), len(words)


def classify(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Pass one: sets ``good`` of the blocks that are clear."""
    counted = [(b, *stop_words(b.text)) for b in blocks if not b.outside]
    total = sum(b.size for b, *_ in counted)
    held = sum(b.size for b, *_ in counted if b.inside)
    framed = held > 0 and held >= rules.main_share * total
    known = sum(n for _, n, _ in counted) >= rules.no_stop_words * sum(n for *_, n in counted)
    for b in blocks:
        if b.outside or framed and not b.inside:
            b.good = False
    for b, stops, words in counted:
        if b.good is False:
            continue
        density = stops / words
        many, some = density >= rules.many_stop_words, density >= rules.few_stop_words or not known
        if b.linked > rules.most_linked * b.size and not (b.inside and many):
            b.good = False
        elif b.size >= rules.short and some and (b.inside or b.size >= rules.long or many):
            b.good = True
        elif not b.inside and b.size < rules.short and ("©" in b.text or "copyright" in b.text.lower().split()):
            b.good = False


def inherit(blocks: list[Block]) -> None:
    """Pass two: blocks still open take the label of their nearest decided neighbours.

    Beyond an article's first and last block stands its border, which is good; beyond the page's ends all is bad."""
    n = len(blocks)
    before: list[tuple[int, bool]] = []  # blocks to the nearest decided one, its label
    for i, b in enumerate(blocks):
        new = b.inside and (i == 0 or blocks[i - 1].article != b.article)
        distance, label = (0, True) if new else before[-1] if i and blocks[i - 1].article == b.article or i and not b.inside else (0, False)
        if i and not new and blocks[i - 1].good is not None:
            distance, label = 0, blocks[i - 1].good
        before.append((distance + 1, label))
    after: list[tuple[int, bool]] = [(0, False)] * n
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        new = b.inside and (i == n - 1 or blocks[i + 1].article != b.article)
        distance, label = (0, True) if new else after[i + 1] if i < n - 1 else (0, False)
        if i < n - 1 and not new and blocks[i + 1].good is not None:
            distance, label = 0, blocks[i + 1].good
        after[i] = (distance + 1, label)
    decided = [b.good if b.good is not None else x[1] if x[1] == y[1] or x[0] < y[0] else y[1] if y[0] < x[0] else True for b, x, y in zip(blocks, before, after)]
    for b, good in zip(blocks, decided):
        b.good = good


def decided(blocks: list[Block], rules: Rules) -> list[Block]:
    """The good blocks by both passes."""
    classify(blocks, rules)
    inherit([b for b in blocks if not (b.inside and b.outside)])  # an advert within an article parts nothing
    return [b for b in blocks if b.good]


def main_text(page: str | None, rules: Rules = Rules()) -> tuple[str, int]:
    """The main text, blocks joined by newlines, and how many blocks that is."""
    blocks = blocks_of(page) if page else []
    kept = decided([replace(b, outside=b.outside or b.marked) for b in blocks], rules)
    if not kept and any(b.marked for b in blocks):
        kept = decided(blocks, rules)
    return "\n".join(b.text for b in kept), len(kept)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks: one row for each row of ``pages``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x, rules) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())],
            ["page_id", "url", "text", "n_chars", "n_blocks"],
        )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return common.map_arrow(rows, step, "page_id long, url string, text string, n_chars long, n_blocks int")
