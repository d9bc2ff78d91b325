"""Main text of web pages from a stream of parser events.

The standard library's parser yields blocks of text, the lines of the page as it
is shown, with the number of tags and the share of link text in each.  The ratio
of text to tags, line by line, is smoothed with a Gaussian; its standard deviation is the threshold that
clusters blocks into content and the rest, and the regions that hold most of
the content are the article.  Within them all blocks stay, however short, but
for parts whose element or name says that they are no article text.  Names are
weak evidence: one that would drop most of a page's content is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of HTML: void elements, elements without article text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style head title template noscript svg math iframe object audio video canvas map form button select textarea "
    "input label fieldset nav aside footer menu dialog".split()
)
# Those of them that stand within lines: text goes on behind them.
INLINE = frozenset("script style template noscript svg math iframe object audio video canvas map button select textarea label".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A new one of these ends an open one of the same group.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

# Names of classes, ids and roles of parts that are no article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar toc tabs "
    "sidebar sidebars rail widget widgets related recommended recommendations trending popular teaser teasers "
    "header masthead topbar footer bottombar colophon copyright contentinfo complementary "
    "comment comments commentlist disqus reply replies respond discussion "
    "notice notices alert cookie cookies consent gdpr disclaimer popup modal overlay dialog newsletter subscribe subscription "
    "signup login search searchbox form share sharing social follow".split()
)
# Elements around whole pages as often as around parts: no more evidence than a name.
WRAPPERS = frozenset("form fieldset dialog".split())
#: So many times the content of the articles outside it outweighs a name.
NAME_WEIGHT = 4
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_LONG_REFERENCE = re.compile(r"&#[0-9]{8,}")
_NOT_SAID = frozenset("with has no without".split())


def says_aside(attributes: list[tuple[str, str | None]]) -> bool | str:
    """Whether an element's class, id, role or style sets it apart from the article.

    "soft" if all it says is that it is a header.
    """
    said: set[str] = set()
    for name, value in attributes:
        if name in ("class", "id", "role"):
            for word in (value or "").split():
                parts = [p.lower() for p in _PARTS.split(word) if p]
                if parts and parts[0] not in _NOT_SAID:
                    said.update(NAMES.intersection(parts))
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value or "", re.I):
            return True
    return "soft" if said == {"header"} else bool(said)


class Blocks(HTMLParser):
    """Collects blocks: [text, tags, link characters, aside, region, name, out].

    ``region`` numbers the outermost article (else main element) around a
    block, 0 where there is none; ``aside`` marks what is no article text.
    ``name`` numbers the innermost element around it that a name sets apart
    (``outer`` has the next one around each), ``out`` marks blocks that go
    whatever the names.  Names of the elements in ``passed`` are passed over.
    """

    def __init__(self, passed: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[tuple[str, bool | str, int, int, bool, bool]] = []  # tag, aside, region, name, out, muted
        self.standing: Counter[str] = Counter()  # open elements by tag
        self.passed, self.outer = passed, [0]
        self.name, self.out, self.muted = 0, False, False
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = self.regions = 0
        self.aside: bool | str = False
        self.region = 0
        self.kinds = {0: ""}

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append([text, self.tags, self.links, self.aside, self.region, self.name, self.out])
            self.tags = 0
        self.links = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
            name = self.open[i][0]
            if name in ENDS and tag in ENDS[name]:
                self._close(i)
                break
            if name in BLOCKS:
                break
        if tag in VOID:
            return
        if tag not in BLOCKS and tag in DROPPED - INLINE:
            self.flush()
        self.open.append((tag, self.aside, self.region, self.name, self.out, self.muted))
        self.standing[tag] += 1
        if tag in INLINE:
            self.muted = True
            return
        said = says_aside(attrs)
        hidden = said is True and says_aside([a for a in attrs if a[0] not in ("class", "id", "role")])
        named = (bool(said) or tag in WRAPPERS) and not hidden and tag not in ("html", "body")
        passed = False
        if named:
            self.outer.append(self.name)
            self.name = len(self.outer) - 1
            passed = self.name in self.passed
        if tag in ("article", "main") and not self.aside and (not self.region or tag == "article" and self.kinds[self.region] == "main"):
            if passed or not says_aside([a for a in attrs if a[0] != "role"]):
                self.regions += 1
                self.region = self.regions
                self.kinds[self.region] = tag
        if passed or tag in ("html", "body", "main"):
            said = False
        dropped = tag in DROPPED and not (passed and tag in WRAPPERS)
        self.out = self.out or bool(hidden) or tag in DROPPED - WRAPPERS
        if self.aside == "soft" and tag in HEADINGS and not said:
            self.aside = False
        elif dropped or said is True:
            self.aside = True
        elif (tag == "header" or said) and not self.aside:
            self.aside = "soft" if self.region else True  # an article's own header keeps its headings
        if tag == "a":
            self.in_link += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "svg", "object"):
            self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        self.flush()
        _, self.aside, self.region, self.name, self.out, self.muted = self.open[at]
        self._drop(at)

    def _drop(self, at: int) -> None:
        for o in self.open[at:]:
            self.standing[o[0]] -= 1
            self.in_link -= o[0] == "a"
        del self.open[at:]

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.standing[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or tag in DROPPED - INLINE or any(o[0] in BLOCKS or o[1] != self.aside for o in self.open[i:]):
                    self._close(i)
                else:
                    self.muted = self.open[i][5]
                    self._drop(i)
                return
            # an inline end tag does not end the block around it
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return

    def parse_marked_section(self, i, report=1):
        """Sections of no known kind are comments."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.muted:
            return
        self.parts.append(data)
        if self.in_link > 0:
            self.links += len(data)


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the edges are repeated."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_blocks(blocks: list[list]) -> np.ndarray:
    """Which blocks cluster as content, by their smoothed text-to-tag ratio."""
    ratio = np.array([(len(b[0]) - b[2]) / max(1, b[1]) for b in blocks], float)
    level = smoothed(ratio)
    return level >= min(level.std(), level.max())


def passed_names(parser: Blocks) -> frozenset[int]:
    """Elements whose name is passed over, as they hold most of the page's content.

    Where an article without such a name holds content too, it has to be
    outweighed by far.
    """
    free = [b for b in parser.blocks if not b[6]]
    if not free or not any(b[5] for b in free):
        return frozenset()
    mass = [0] * len(parser.outer)
    articles = 0
    for block, yes in zip(free, content_blocks(free).tolist(), strict=True):
        n = (len(block[0]) - block[2]) * yes
        mass[block[5]] += n
        if not block[3] and parser.kinds[block[4]] == "article":
            articles += n
    for k in range(len(mass) - 1, 0, -1):
        mass[parser.outer[k]] += mass[k]
    # Names inside an article leave its own text; those around it are held against none.
    inside = [0] * len(mass)
    for block in free:
        if not block[3] and parser.kinds[block[4]] == "article":
            inside[block[5]] = 1
    for k in range(len(mass) - 1, 0, -1):
        inside[parser.outer[k]] |= inside[k]
    return frozenset(k for k in range(1, len(mass)) if 2 * mass[k] > mass[0] and (inside[k] or mass[k] > NAME_WEIGHT * articles))


def _reference(found: re.Match) -> str:
    """A numeric reference of many digits in few, or the sign for what is no character."""
    digits = found[0][2:].lstrip("0") or "0"
    return f"&#{digits}" if len(digits) < 8 else "&#65533"


def closable(html: str) -> str:
    """``html`` with what the parser cannot end as text: it would look for each end up to the page's.

    That is tags behind the last ``>`` and comments and sections behind their
    last end.  Numeric references of very many digits are put in few.
    """
    if _LONG_REFERENCE.search(html):
        html = _LONG_REFERENCE.sub(_reference, html)
    for begin, end in (("<!--", "--"), ("<![", "]]"), ("<", ">")):
        at = html.rfind(end) + len(end)
        if html.find(begin, at) >= 0:
            html = html[:at] + html[at:].replace(begin, "&lt;" + begin[1:])
    return html


def _parsed(html: str, passed: frozenset[int] = frozenset()) -> Blocks:
    parser = Blocks(passed)
    parser.feed(closable(html))
    parser.close()
    parser.flush()
    return parser


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by line feeds."""
    if not html:
        return ""
    parser = _parsed(html)
    passed = passed_names(parser)
    if passed:
        parser = _parsed(html, passed)
    own = [b for b in parser.blocks if not b[3]]
    if not own:
        return ""
    content = content_blocks(own)
    mass: dict[int, int] = {}
    for block, yes in zip(own, content.tolist(), strict=True):
        mass[block[4]] = mass.get(block[4], 0) + (len(block[0]) - block[2]) * yes
    marked = {r: m for r, m in mass.items() if r}
    if marked and sum(marked.values()) >= mass.get(0, 0):
        # An article inside main stands for it if it holds content; of several, those above the threshold of their contents.
        articles = {r: m for r, m in marked.items() if parser.kinds[r] == "article" and m} or marked
        level = np.std(list(articles.values()))
        best = {r for r, m in articles.items() if m >= min(level, max(articles.values()))}
        return "\n".join(b[0] for b in own if b[4] in best)
    # No element marks the article, or most content is outside: from the first content block to the last, without lists of links.
    at = np.flatnonzero(content & np.array([2 * b[2] <= len(b[0]) for b in own]))
    if not len(at):
        return ""
    first, last = at[0], at[-1]
    while first and 2 * own[first - 1][2] <= len(own[first - 1][0]):
        first -= 1
    while last + 1 < len(own) and 2 * own[last + 1][2] <= len(own[last + 1][0]):
        last += 1
    return "\n".join(b[0] for b in own[first : last + 1] if 2 * b[2] <= len(b[0]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty html gives empty text, and so does html without an article;
    broken markup is read as far as the parser goes, never refused.  Repeated
    rows are rows of their own, null ids and urls stay null, and other columns
    of ``pages`` are left behind whatever their names.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
