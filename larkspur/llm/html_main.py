"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into block lines, each with
its text length and number of tags.  The ratio of the two is smoothed along the
page with a Gaussian, lines are clustered by a threshold on the smoothed ratio,
and the cluster above it says which sections of the page hold the content: all
outermost ``article`` and ``main`` parts with a line of it, if at least half of their
text belongs to it; else its own lines, with those that they enclose inside a
section.  On a page without such parts it is the
smallest section outside of which no line of it and no heading lies; parts
without such lines and without any text but links are left out.  All other lines
of these sections are returned, short ones too.  Lines in menus, headers,
footers, sidebars, notices, adverts, forms and comment sections take part in the smoothing and
the threshold but are never returned; scripts, styles and other unseen elements are no lines.

A block's text has its character references decoded and its white space turned
into single spaces; blocks are joined in page order by one newline.

Defined results for odd input: a null or empty page, or one without content,
gives an empty text; text outside any tag is a block of its own; unclosed tags
end with their parents or with the page, paragraphs, items, rows and cells also
where the next one opens; plain text is returned as it is; rows
repeat as they come; an empty table gives an empty table.  A page is read in
pieces, and its length isn't limited.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and words that sites use in
# class, id and role attributes of parts that aren't content.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SECTIONS = frozenset("article main section div td body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio button canvas datalist embed head iframe input map noscript object optgroup option script select style svg template textarea title video".split())
DROPPED = UNSEEN | frozenset("aside dialog footer form menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-share comment comments commentlist comment-list comments-area consent cookie cookies cookie-banner disclaimer disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup popover promo promoted promotion related related-posts respond share sharing sidebar side-bar site-header site-footer skip-link social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT_ROLES = frozenset(["main", "article"])
NOISE_PREFIX = re.compile(r"(?:ad|ads|advert|banner|comment|comments|cookie|footer|menu|nav|newsletter|notice|promo|sidebar|share|social|sponsor|widget)[-_]|.*[-_](?:ad|ads|advert|banner|comments?|cookies?|footer|menu|nav|newsletter|notice|promo|sidebar|widget)$")
READ_CHARS = 1 << 16
#: Share of the marked sections' text that the clusters have to hold.
CONFIRMED = 0.5
#: Elements whose end tag may be left out: which open ones a start tag ends, and where the search for them stops.
ENDED = {t: (frozenset(ended.split()), frozenset(stop.split())) for tags, ended, stop in [
    ("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("td th", "td th", "tr table"), ("tr", "tr", "table"), ("tbody thead tfoot", "tbody thead tfoot caption", "table"),
] for t in tags.split()}


class Line:
    __slots__ = ("heading", "links", "noise", "parts", "section", "tags")

    def __init__(self, section: int, heading: bool, noise: bool = False) -> None:
        self.parts: list[str] = []
        self.tags = 1
        self.links = True  # whether all its text is in links
        self.section = section
        self.heading = heading
        self.noise = noise  # it counts as a line, but can't be returned


class BlockReader(HTMLParser):
    """Collects block lines from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [-1]  # of each section; section 0 is the page
        self.kinds = ["page"]
        self.marked = [False]  # whether a section is a content section or lies in one
        self.open: list[tuple[str, int]] = []  # element and the section around it
        self.at: dict[str, list[int]] = {}  # positions of each name in ``open``
        self.section = 0
        self.skipped = ""  # the element that isn't content
        self.depth = 0
        self.unseen = ""  # the element inside it, or itself, whose text isn't seen on a page
        self.unseen_depth = 0
        self.line: Line | None = None
        self.in_link = False

    def _noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":
            return not self.marked[self.section]
        if tag in ("body", "html", "article", "main"):
            wanted = ("class", "id") if tag == "article" else ()
        else:
            wanted = ("class", "id")
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true":
            return tag not in ("body", "html")
        if given.get("role", "").lower() in NOISE_ROLES:
            return tag not in ("body", "html")
        words = [w for k in wanted for w in given.get(k, "").lower().split()]
        return any(w in NOISE or NOISE_PREFIX.match(w) for w in words)

    def _close(self, position: int) -> None:
        """End the open element at ``position`` and all inside it."""
        self.section = self.open[position][1]
        for tag, _ in self.open[position:]:
            self.at[tag].pop()
        del self.open[position:]

    def _last(self, tags: frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _end_siblings(self, tag: str) -> None:
        """End what ``tag`` ends by opening: a paragraph, or a sibling without an end tag."""
        if self.open and self.open[-1][0] == "p":
            self._close(len(self.open) - 1)
        if tag in ENDED:
            ended, stop = ENDED[tag]
            bound = self._last(stop)
            if inside := [self.at[t][-1] for t in ended if self.at.get(t) and self.at[t][-1] > bound]:
                self._close(min(inside))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            self.depth += tag == self.skipped
            if self.unseen:
                self.unseen_depth += tag == self.unseen
            elif tag in UNSEEN and tag not in VOID:
                self.unseen, self.unseen_depth = tag, 1
            elif tag in BLOCKS:
                self.line = None
            elif self.line is not None:
                self.line.tags += 1
            return
        if tag in BLOCKS:
            self._end_siblings(tag)
        if self._noise(tag, attrs):
            if tag not in VOID:
                self.skipped, self.depth = tag, 1
                self.unseen, self.unseen_depth = (tag if tag in UNSEEN else ""), 1
                if not self.unseen:  # what follows an unseen element continues its line
                    self.line = None
            if tag in BLOCKS:
                self.line = None
            return
        if tag in BLOCKS:
            self.line = None
            content = tag in ("article", "main") or dict(attrs).get("role") in CONTENT_ROLES
            if tag not in VOID:
                self.at.setdefault(tag, []).append(len(self.open))
                self.open.append((tag, self.section))
            if tag in SECTIONS or content:
                self.parents.append(self.section)
                self.marked.append(content or self.marked[self.section])
                self.kinds.append("content" if content else tag)
                self.section = len(self.parents) - 1
            self.in_link = False
        else:
            self.in_link |= tag == "a"
        if tag not in BLOCKS and self.line is not None:
            self.line.tags += 1
            if tag == "br":
                self.line.parts.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.skipped and tag in BLOCKS:
            self.line = None

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.unseen:
                self.unseen_depth -= 1
                if not self.unseen_depth:
                    self.unseen = ""
            elif not self.unseen and tag in BLOCKS:
                self.line = None
            if tag == self.skipped:
                self.depth -= 1
                if not self.depth:
                    self.skipped = self.unseen = ""
                    if self.line is not None and self.line.noise:
                        self.line = None
            return
        if tag not in BLOCKS:
            self.in_link &= tag != "a"
            return
        self.line = None
        if self.at.get(tag):
            self._close(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(self.section, not self.skipped and bool(self.open) and self.open[-1][0] in HEADINGS, bool(self.skipped))
            self.lines.append(self.line)
        self.line.parts.append(data)
        self.line.links &= self.in_link or not data.strip()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing along the lines, renormalised at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel, mode="full")[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach : reach + len(ratios)]


def clustered(lengths: list[int], tags: list[int]) -> list[bool]:
    """Which lines lie in runs of smoothed text-to-tag ratios that reach the threshold.

    Smoothing blurs a run's ends, which are cut back to lines that reach it themselves.
    """
    own = np.array(lengths, dtype=float) / np.array(tags, dtype=float)
    level = smoothed(own)
    least = min(level.std(), level.mean())
    high = level >= least
    run = np.cumsum(np.concatenate([[True], high[1:] != high[:-1]]))
    sure = np.nonzero(high & (own >= least))[0]
    if not len(sure):
        return high.tolist()
    first, last = np.full(run[-1] + 1, len(own)), np.full(run[-1] + 1, -1)
    np.minimum.at(first, run[sure], sure)
    np.maximum.at(last, run[sure], sure)
    at = np.arange(len(own))
    return ((first[run] <= at) & (at <= last[run])).tolist()


def content_lines(reader: BlockReader, lengths: list[int]) -> list[bool]:
    """Which lines to return.

    Marked content sections with a line above the threshold are returned whole if at
    least ``CONFIRMED`` of their text together is above it.  If not, the lines above it are returned
    with those that they enclose inside a section.  On a page without marked sections it is the
    innermost section that leaves no line above the threshold and no heading outside,
    less its parts that hold links alone.
    """
    n = len(reader.parents)
    held, content, other = [0] * n, [0] * n, [0] * n
    text, above_text = [0] * n, [0] * n
    high = clustered(lengths, [x.tags for x in reader.lines])
    for x, above, length in zip(reader.lines, high, lengths, strict=True):
        if x.noise:
            continue
        content[x.section] += above
        held[x.section] += above or x.heading
        other[x.section] += above or x.heading or not x.links  # lines that are no links
        text[x.section] += length
        above_text[x.section] += length * above
    for s in range(n - 1, 0, -1):
        for count in (held, content, other, text, above_text):
            count[reader.parents[s]] += count[s]
    marked = {s for s, kind in enumerate(reader.kinds) if kind == "content" and not reader.marked[reader.parents[s]]}
    inside, unwanted = {s for s in marked if content[s]}, []
    if sum(text[s] for s in marked):
        if not inside or sum(above_text[s] for s in inside) < CONFIRMED * sum(text[s] for s in inside):
            return enclosed(reader.lines, high)
    else:
        best = 0
        for s in range(1, n):  # sections are numbered from the outside in
            if held[s] == held[0] and reader.parents[s] == best:
                best = s
        inside, unwanted = {best}, [not k for k in other]
        unwanted[best] = False
    for s in range(min(inside) + 1, n):
        if reader.parents[s] in inside and not (unwanted and unwanted[s]):
            inside.add(s)
    return [x.section in inside and not x.noise for x in reader.lines]


def enclosed(lines: list[Line], high: list[bool]) -> list[bool]:
    """Lines above the threshold and those between two of them in one section."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, (x, above) in enumerate(zip(lines, high, strict=True)):
        if above and not x.noise:
            first.setdefault(x.section, i)
            last[x.section] = i
    return [not x.noise and first.get(x.section, len(lines)) <= i <= last.get(x.section, -1) for i, x in enumerate(lines)]


def main_text(html: str | None) -> str:
    """The content blocks of one page, joined by newlines."""
    if not html:
        return ""
    reader = BlockReader()
    for at in range(0, len(html), READ_CHARS):
        reader.feed(html[at : at + READ_CHARS])
    reader.close()
    texts = [" ".join("".join(x.parts).split()) for x in reader.lines]
    kept = [i for i, t in enumerate(texts) if t]
    reader.lines = [reader.lines[i] for i in kept]
    texts = [texts[i] for i in kept]
    if all(x.noise for x in reader.lines):
        return ""
    return "\n".join(t for t, keep in zip(texts, content_lines(reader, [len(t) for t in texts]), strict=True) if keep)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out`` in place of ``html``."""

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    return pages.withColumn(out, extract(F.col(f"`{html}`"))).drop(*[html] if html != out else [])
