"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Method
  1. The standard library's parser streams through the whole page. Each block of text between block-level tags is a line; its ratio is its
     characters per tag since the line before, with the one that ends it. Scripts, styles and the like give no text.
  2. A line is set aside if it stands in a menu, page header, footer, sidebar or dialog element, or if it lies outside articles and is mostly link text. Names are evidence only: an element
     whose class, id or role names an advert, notice, comment section and so on, and a form, is set aside unless most of the page's text is in it (of comments: with an article, main or h1 element, too);
     where nothing else is left its paragraphs and headings stay. Forms like ``has-sidebar`` or ``comments-open`` say what an element holds, not what it is, and count for nothing. Words that may mean
     either (``side-note``, ``notice-board``) halve their lines' ratios and set nothing aside; names of headings don't count, nor do header words within articles and main elements.
  3. The ratios of all lines (those set aside count as 0) are smoothed by a Gaussian; two-means clustering of the smoothed ratios gives the threshold.
  4. A region is the innermost article, or else main element, or else container, of a line. Regions with a line above the threshold are content; if the page has articles
     or main elements, only those come into question, and the one with most text is taken if none passes. All lines of an article or main element that aren't set aside are
     kept, however short. Of a mere container, lines that are neither paragraphs nor headings and stand below the threshold at its beginning or end (before its first or after its last
     line above it) go as well: there only the ratio tells a menu or a footer from the text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page order. A null or empty
page, or one without content, gives the empty text. An unclosed element ends with its parent; a comment or tag that nothing closes runs to the end of the page, a marked section
to its ``]]>`` or else the next ``>``; a tag with malformed attributes is a tag. Invalid UTF-8 is read with replacement characters. No page raises, and the time is linear in its length.
Repeated rows are extracted each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe object select option textarea button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav footer aside menu dialog search".split())
REGION = frozenset("article main section div td body".split())
# Words in class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget header masthead footer share sharing social "
    "related recommended newsletter subscribe signup login search form comment comments reply replies disqus discussion pagination pager complementary contentinfo dialog".split()
)
# Beginnings of words that keep this meaning in any compound.
STEMS = tuple("advert sponsor promo cookie consent gdpr sidebar comment disqus footer breadcrumb navbar navigation newsletter subscri popup recommend pagination".split())
# Words that don't change what the others of a compound mean.
GENERIC = frozenset(
    "area bar block bottom box button buttons container content contents global group holder icons inner item items left link links list main message messages module news outer page panel posts articles stories primary region right secondary section site slot text top unit wrap wrapper zone".split()
)
# Words of names that tell what an element holds or which state it is in.
STATES = frozenset("has no with without not is are show hide shown hidden open closed on off enabled disabled allow allowed support supports".split())
# Words of reader comments, of page headers, and of what names the article itself.
TALK = frozenset("comment comments reply replies disqus discussion".split())
TOPS = frozenset("header masthead banner".split())
OWN = frozenset("article post entry story body prose content text".split())
#: What names say of an element.
NOTHING, MAYBE, OTHER, COMMENTS = range(4)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: Width of the Gaussian, in lines.
SIGMA = 1.0


# Elements whose lines are prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_COMMENT_END = re.compile(r"--!?\s*+>")
_LONG_NUMBER = re.compile(r"&#[0-9]{1000}")
_NUMBER = re.compile(r"&#0*+([0-9]*+)")


@lru_cache(10_000)
def meaning(names: str, inside: bool, heading: bool) -> int:
    """What the blank-separated names (classes, id, role) of an element say; ``inside`` an article or main element, or of a ``heading``, words of headers don't count."""
    out = NOTHING
    own = False
    for name in names.split():
        words = [w for w in map(str.lower, _SPLIT.split(name)) if w and not w.isdigit()]
        marks = [w for w in words if (w in MARKS or w.startswith(STEMS)) and not (w in TOPS and (inside or heading))]
        if not marks:
            own |= any(w in OWN for w in words)
        elif not STATES.intersection(words):
            sure = any(w.startswith(STEMS) for w in marks) or all(w in MARKS or w in GENERIC for w in words)
            out = max(out, (COMMENTS if any(w in TALK for w in marks) else OTHER) if sure else MAYBE)
    return min(out, MAYBE) if own and out == OTHER else out


class _Mark:
    """An element that is set aside unless the page's text is in it."""

    __slots__ = ("parent", "talk", "holds", "chars")

    def __init__(self, parent: int, talk: bool):
        self.parent, self.talk, self.holds, self.chars = parent, talk, False, 0


class _Open(NamedTuple):
    """An open element, with what holds for the text in it."""

    tag: str
    silent: bool
    aside: bool
    region: int
    rank: int
    linked: bool
    #: Place of the paragraph that the next block ends, or -1.
    paragraph: int
    #: The innermost block.
    block: str
    #: The innermost marked element, or -1, and whether its lines count half.
    mark: int
    half: bool


_ROOT = _Open("", False, False, 0, 0, False, -1, "", -1, False)


class _Line(NamedTuple):
    text: str
    tags: int
    aside: bool
    region: int
    rank: int
    linked: float
    prose: bool
    mark: int
    half: bool


class _Lines(HTMLParser):
    """Lines of a page that is fed as a whole; what the end of the page cuts off counts as closed there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.regions = 0
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0
        self.lines: list[_Line] = []
        self.marks: list[_Mark] = []
        self.cdata_ends = True

    def _top(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def _cut(self, i: int):
        """Closes the elements from place ``i`` on."""
        self.open.subtract(e.tag for e in self.stack[i:])
        del self.stack[i:]

    def flush(self):
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            top = self._top()
            self.lines.append(_Line(line, max(1, self.tags), top.aside, top.region, top.rank, self.linked / len(line), top.block in PROSE, top.mark, top.half))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if (p := self._top().paragraph) >= 0:  # a block ends an open paragraph, with what was left open in it
                self._cut(p)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        top = self._top()
        aside, region, rank, mark, half = top.aside, top.region, top.rank, top.mark, top.half
        names = []
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                names.append(value)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                aside = True
        said = NOTHING
        if tag not in ("html", "body", "main"):
            said = meaning(" ".join(names), rank > 0, tag in HEADINGS) if names else NOTHING
            if tag in ("form", "fieldset"):
                said = max(said, OTHER)
        if tag in ASIDE or tag == "header" and rank == 0:
            aside = True
        elif said >= OTHER and tag != "header":
            self.marks.append(_Mark(mark, said == COMMENTS))
            mark = len(self.marks) - 1
        elif tag in ("article", "main", "h1"):
            m = mark
            while m >= 0 and not self.marks[m].holds:
                self.marks[m].holds = True
                m = self.marks[m].parent
        half = half or said == MAYBE
        if tag in REGION and not aside:
            new = 2 if tag == "article" else 1 if tag == "main" else 0
            if new >= rank:
                self.regions += 1
                region, rank = self.regions, new
        paragraph = len(self.stack) if tag == "p" else -1 if tag in BLOCK else top.paragraph
        self.stack.append(_Open(tag, top.silent or tag in SILENT, aside, region, rank, top.linked or tag == "a", paragraph, tag if tag in BLOCK else top.block, mark, half))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.open[tag] > 0:
            i = len(self.stack) - 1
            while self.stack[i].tag != tag:  # all that is passed over is closed with it
                i -= 1
            self._cut(i)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")

    def handle_data(self, data):
        top = self._top()
        if not top.silent:
            self.text.append(data)
            if top.linked:
                self.linked += len(data)

    # markup that the library's parser would give out as text, or refuse

    def parse_starttag(self, i):
        page = self.rawdata
        name = _TAG.match(page, i)
        at, attrs = name.end(), []
        while at < len(page) and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            if m[1] or m.end() > at:
                if m[1]:
                    value = next((v for v in m.groups()[1:] if v is not None), None)
                    attrs.append((m[1].lower(), unescape(value) if value else value))
                at = m.end()
            else:
                at += 1
        if at >= len(page):
            return len(page)
        self.lasttag = tag = name[1].lower()
        if page[at - 1] == "/" and at - 1 >= name.end():
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return at + 1

    def parse_endtag(self, i):
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=True):
        page = self.rawdata
        for empty in (">", "->"):
            if page.startswith(empty, i + 4):
                return i + 4 + len(empty)
        end = _COMMENT_END.search(page, i + 4)
        return end.end() if end else len(page)

    def parse_pi(self, i):
        return self._after(">", i)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![CDATA[", i) and self.cdata_ends:
            if self.rawdata.find("]]>", i) >= 0:
                return self._after("]]>", i)
            self.cdata_ends = False  # nor does any later one
        return self._after(">", i)

    def _after(self, mark: str, i: int) -> int:
        at = self.rawdata.find(mark, i)
        return at + len(mark) if at >= 0 else len(self.rawdata)


def _numbers(page: str) -> str:
    """``page`` with numeric references of absurd length cut to one that is beyond all characters, too."""
    return _NUMBER.sub(lambda m: f"&#{m[1][:9] or 0}", page) if _LONG_NUMBER.search(page) else page


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the weights that are left count as all."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mid = slice(reach, reach + len(x))
    return np.convolve(x, kernel)[mid] / np.convolve(np.ones(len(x)), kernel)[mid]


def threshold(x: np.ndarray) -> float:
    """Halfway between the centres of two clusters of the values (two-means from the extremes)."""
    lo, hi = float(x.min()), float(x.max())
    while True:
        cut = (lo + hi) / 2
        low, high = x[x <= cut], x[x > cut]
        if not len(low) or not len(high):
            return min(cut, lo)
        new = float(low.mean()), float(high.mean())
        if new == (lo, hi):
            return cut
        lo, hi = new


def _set_aside(lines: list[_Line], marks: list[_Mark]) -> list[bool]:
    """Which marked elements go: those that don't hold most of the text, and what is in them."""
    total = 0
    for x in lines:
        if not x.aside:
            total += len(x.text)
            if x.mark >= 0:
                marks[x.mark].chars += len(x.text)
    for m in reversed(marks):
        if m.parent >= 0:
            marks[m.parent].chars += m.chars
    gone: list[bool] = []
    for m in marks:
        stays = 2 * m.chars > total and (m.holds or not m.talk)
        gone.append(not stays or m.parent >= 0 and gone[m.parent])
    return gone


def main_text(html: str) -> str:
    parser = _Lines()
    parser.feed(_numbers(html))
    parser.close()
    parser.flush()
    lines = parser.lines
    gone = _set_aside(lines, parser.marks)
    plausible = [not x.aside and not (x.rank == 0 and x.linked > 0.5) for x in lines]
    kept = [ok and (x.mark < 0 or not gone[x.mark]) for x, ok in zip(lines, plausible, strict=True)]
    if not any(kept):
        kept = [ok and x.prose for x, ok in zip(lines, plausible, strict=True)]
    if not any(kept):
        return ""
    best = max(x.rank for x, ok in zip(lines, kept, strict=True) if ok)
    level = smooth(np.array([len(x.text) / x.tags / (1 + x.half) if ok else 0.0 for x, ok in zip(lines, kept, strict=True)]))
    cut = threshold(level)
    amount: dict[int, int] = {}
    span: dict[int, tuple[int, int]] = {}  # of a region: its first and last line above the threshold
    for i, (x, ok) in enumerate(zip(lines, kept, strict=True)):
        if ok and x.rank == best:
            amount[x.region] = amount.get(x.region, 0) + len(x.text)
            if level[i] > cut:
                span[x.region] = (span.get(x.region, (i, i))[0], i)
    span = span or {max(amount, key=lambda r: (amount[r], -r)): (0, len(lines))}

    def chosen(i: int, x: _Line) -> bool:
        if not kept[i] or x.rank != best or x.region not in span:
            return False
        first, last = span[x.region]
        return best > 0 or x.prose or first <= i <= last

    return " ".join(x.text for i, x in enumerate(lines) if chosen(i, x))


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.decode("utf-8", "replace")) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of ``pages`` (page_id long, url string, html string)."""
    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(lean(_extract), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
