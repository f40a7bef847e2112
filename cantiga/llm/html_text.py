"""Main text of web pages: parser events, text-to-tag ratios, smoothed and clustered.

The standard library's parser streams its events into blocks, the "lines" of
a page.  Each has a ratio of characters to tags; the ratios are smoothed with a
Gaussian along the page, and lines over the page's standard deviation are
content.  The regions such lines lie in are kept whole, so that a short
paragraph goes with its article; so are short regions beside them in one
element that are not mostly links.  Lines in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are never
content.  Where the elements that a page marks as articles hold most of its
content, nothing outside is, nor are articles that hold little beside the
largest; where they hold less than what is outside, they are teasers.  A class,
id or role only marks a part by a token that names it, and not on an element
that turns out to hold the article or most of the page's text; nor does a form
with most of the text in paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NOT_TEXT = frozenset("aside button dialog footer head header iframe math menu nav noscript object script select style svg template textarea title".split())
_ARTICLE = frozenset(("article", "main"))
_NEVER_MARKED = frozenset(("html", "body", "main", "article"))
#: Words of class, id and role that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond "
    "replies social share sharing related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination "
    "pager search contentinfo complementary form".split()
)
#: Marks that hold however much text lies in them.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus respond replies "
    "newsletter subscribe popup".split()
)
#: What may follow a mark in a token that names a part of the page.
_PARTS = frozenset("area bar block box buttons items links list posts section slot unit".split())
#: Tokens with these say something about the page, not what the element is.
_ABOUT = frozenset("above after before below has hide layout no non not template theme with without".split())
#: Before "header", what it is the header of.
_OF_ARTICLE = frozenset("article entry post story".split())
_MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: An opening tag of the first closes an open one of these.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an element to close stops.
_SCOPES = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())
#: What a form around an article has, and one to fill in has not.
_PROSE = frozenset("p h1 h2 h3 article main".split())
SIGMA = 2.0
#: An article counts beside the largest if it holds this share of its content.
BESIDE = 0.25


def mark_of(value: str, in_article: bool) -> str | None:
    """The mark among the tokens of a class, id or role; one that always holds goes first."""
    found = []
    for token in value.split():
        words = [w.lower() for w in _MARK_WORD.findall(token) if not w.isdigit()]
        if not words or _ABOUT.intersection(words):
            continue
        mark = token.lower() if token.lower() in _MARKS else words[-2] if len(words) > 1 and words[-1] in _PARTS else words[-1]
        if mark in _MARKS and not (mark == "header" and (in_article or _OF_ARTICLE.intersection(words))):
            found.append(mark)
    return min(found, key=lambda m: m not in _SURE, default=None)


@dataclass
class Line:
    text: str
    tags: int
    #: Characters that are in links.
    linked: int
    #: Which region of the page it lies in; -1 in what is never content.
    region: int
    #: Which of the elements marked as articles it lies in; 0 outside.
    article: int
    #: The innermost marked element around it; -1 for none.
    mark: int = -1


class _Open(NamedTuple):
    tag: str
    #: Left out of the text.
    out: bool
    region: int
    article: int
    mark: int
    in_link: bool


@dataclass
class _Mark:
    """An element that a class, id, role or its tag marks as no part of the article."""

    name: str
    #: The marked element around it.
    parent: int
    #: It holds the article, by its tags.
    holds: bool = False
    prose: bool = False


class _Lines(HTMLParser):
    """The lines of a page, in order; time grows with the page, however its tags nest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open = [_Open("", False, 0, 0, -1, False)]
        #: Where the open elements of a name lie, and those at which searches stop.
        self._at: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self.marks: list[_Mark] = []
        #: The region around each region; 0 is the page, and so are bodies.
        self.around = [0]
        self._text: list[str] = []
        self._tags, self._linked, self._articles = 0, 0, 0
        self._unclosed: dict[str, int] = {}

    def read(self, html: str) -> None:
        # A tag that is not closed at the end is none, and would be looked for again from each "<".
        end = html.rfind(">") + 1
        self.feed(html[:end] + html[end:].partition("<")[0])
        self._unclosed.clear()
        self.close()
        self.flush()

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._closed("comment", i, lambda: super(_Lines, self).parse_comment(i, report))

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        def parse() -> int:
            try:
                return super(_Lines, self).parse_marked_section(i, report)
            except AssertionError:
                # A section of no known kind is a comment.
                return self.parse_bogus_comment(i)

        return self._closed("section", i, parse)

    def _closed(self, kind: str, i: int, parse: Callable[[], int]) -> int:
        """What has no end from one place on has none from a later one, and is not searched again."""
        if i >= self._unclosed.get(kind, i + 1):
            return -1
        k = parse()
        if k < 0:
            self._unclosed[kind] = i
        return k

    def flush(self) -> None:
        text = " ".join("".join(self._text).split())
        top = self._open[-1]
        if text:
            self.lines.append(Line(text, self._tags, min(self._linked, len(text)), -1 if top.out else top.region, top.article, top.mark))
            self._tags = 0
        self._text.clear()
        self._linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
        self._tags += 1
        if tag in _VOID:
            if tag in ("br", "wbr"):
                self._text.append(" " if tag == "br" else "")
            return
        if tag in _CLOSES:
            last = self._last(_CLOSES[tag])
            if last and last >= (self._scopes[-1] if self._scopes else 0):
                self._cut(last)
        _, out, region, article, mark, in_link = self._open[-1]
        # The header of an article holds its title.
        out = out or (tag in _NOT_TEXT and not (tag == "header" and article))
        if not out and mark >= 0:
            if tag == "main" or (tag == "h1" and self._at.get("article")):
                self.marks[mark].holds = True
            self.marks[mark].prose |= tag in _PROSE
        if tag not in _NEVER_MARKED and not (tag == "header" and article):
            values = " ".join(value for name, value in attrs if name in ("class", "id", "role") and value)
            name = (mark_of(values, bool(article)) if values else None) or ("form" if tag == "form" else None)
            if name:
                self.marks.append(_Mark(name, mark))
                mark = len(self.marks) - 1
        if tag in _ARTICLE and not out and not article:
            self._articles += 1
            article = self._articles
        if tag in _ARTICLE or (tag in ("section", "div", "td", "body") and not article):
            if tag == "body":
                region = 0
            else:
                self.around.append(region)
                region = len(self.around) - 1
        self._at.setdefault(tag, []).append(len(self._open))
        if tag in _SCOPES:
            self._scopes.append(len(self._open))
        self._open.append(_Open(tag, out, region, article, mark, in_link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash at the end of a tag that is not void has no meaning.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        self._tags += 1
        last = self._last((tag,))
        if last:
            self._cut(last)

    def _last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these; 0 without one."""
        return max((self._at[tag][-1] for tag in tags if self._at.get(tag)), default=0)

    def _cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        for closed in self._open[place:]:
            self._at[closed.tag].pop()
        del self._open[place:]
        while self._scopes and self._scopes[-1] >= place:
            self._scopes.pop()

    def handle_data(self, data: str) -> None:
        top = self._open[-1]
        if top.out and top.tag in ("script", "style"):
            return
        self._text.append(data)
        if top.in_link:
            self._linked += len(data)


def lines(html: str) -> tuple[list[Line], list[int]]:
    """The lines of a page, those where a mark holds out of every region, and the region around each region."""
    parser = _Lines()
    parser.read(html)
    return _without_marked(parser), parser.around


def _without_marked(parser: _Lines) -> list[Line]:
    marks = parser.marks
    inner_first = range(len(marks) - 1, -1, -1)
    for i in inner_first:
        if marks[i].parent >= 0:
            above = marks[marks[i].parent]
            above.holds |= marks[i].holds
            above.prose |= marks[i].prose

    def within(stands: list[bool]) -> list[bool]:
        """Whether a mark or one around it stands; the last entry is for lines without one."""
        out = []
        for mark, own in zip(marks, stands):
            out.append(own or (mark.parent >= 0 and out[mark.parent]))
        return [*out, False]

    sure = [m.name in _SURE and not m.holds for m in marks]
    left_out = within(sure)
    shown = [x for x in parser.lines if x.region >= 0 and not left_out[x.mark]]
    inside = [0] * (len(marks) + 1)
    for line in shown:
        inside[line.mark] += len(line.text)
    for i in inner_first:
        if marks[i].parent >= 0:
            inside[marks[i].parent] += inside[i]
    half = sum(len(x.text) for x in shown) / 2
    stands = [s or (not m.holds and (inside[i] <= half or (m.name == "form" and not m.prose))) for i, (m, s) in enumerate(zip(marks, sure))]
    gone = within(stands)
    return [replace(x, region=-1) if gone[x.mark] else x for x in parser.lines]


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian along the page; at its ends the weights are those that lie on it."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def _articles(found: list[Line], dense: list[bool]) -> set[int]:
    """The articles that are content by the characters of their dense lines; 0 for what is outside."""
    holds: dict[int, int] = {}
    for line, is_dense in zip(found, dense):
        if line.region >= 0:
            holds[line.article] = holds.get(line.article, 0) + (len(line.text) if is_dense else 0)
    outside = holds.pop(0, 0)
    if not holds or outside > sum(holds.values()):
        return {0}
    return {a for a, n in holds.items() if n >= BESIDE * max(holds.values())}


def _content(found: list[Line], dense: list[bool], candidates: list[bool], around: list[int]) -> set[int]:
    """The regions that are content.

    Those with a dense line, and those that go with them: in an element that has
    dense lines of its own or two such parts.  What is mostly links is neither,
    where anything else is.
    """
    size: dict[int, list[int]] = {}
    for line, candidate in zip(found, candidates):
        if candidate:
            of = size.setdefault(line.region, [0, 0])
            of[0] += len(line.text)
            of[1] += line.linked
    has_dense = {x.region for x, d, c in zip(found, dense, candidates) if d and c} or set(size)
    prose = {r for r, (n, linked) in size.items() if 2 * linked < n}
    regions = has_dense & prose or has_dense
    parts: dict[int, int] = {}
    for region in regions:
        parts[around[region]] = parts.get(around[region], 0) + 1
    return regions | {r for r in prose if around[r] and (around[r] in regions or parts.get(around[r], 0) > 1)}


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article of a page, a block a line; empty for null and for pages without text."""
    if not html:
        return ""
    found, around = lines(html)
    if not any(x.region >= 0 for x in found):
        return ""
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) if x.region >= 0 else 0.0 for x in found]), sigma)
    dense = (ratios >= ratios.std()).tolist()
    articles = _articles(found, dense)
    candidates = [x.region >= 0 and x.article in articles for x in found]
    regions = _content(found, dense, candidates, around)
    return "\n".join(x.text for x, c in zip(found, candidates) if c and x.region in regions)


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, sigma: float = SIGMA) -> DataFrame:
    """``keep`` (all other columns by default), ``text`` and ``n_chars`` (its code points) of every page.

    A null or empty page has an empty text.  Pages are read whole, broken markup
    too.  Repeated rows each get their row; columns named text or n_chars give
    way to the operator's own; an empty table gives no rows.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in (html.lower(), "text", "n_chars")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sigma) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"]
            )

    kept = pages.select(F.col(f"`{html}`").cast("string").alias("__html"), *[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:]) + "text string, n_chars long"
    return kept.mapInArrow(each, schema)
