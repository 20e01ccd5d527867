"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives the events. A line is what stands between two block boundaries (start or end of a
block element, or a line break). Its ratio is its text outside links and boilerplate over the tags in it, on a logarithmic scale. The ratios of
all lines are smoothed with a Gaussian and cut at a threshold between their two clusters (two-means); lines over it are the seeds.

The seeds decide on every page. The region is the articles (else the mains) that hold seeds, if together they hold most of the seeds' text;
else the innermost container of nine tenths of it, with the headings and paragraphs beside it and the seeds outside that are no neighbours' work. All lines of the
region are kept, so that a short paragraph between long ones, or a heading, is not lost to the threshold; but not an article in it without any seed (a card).

Elements and names are features. Text in menus, footers, asides, forms, scripts and the like counts nothing, nor does text in an element whose class or id is
made of boilerplate words (menu, cookie, comment, ...). Such a name, or a form, header or aside, is excused where articles inside it hold most of the
seeds' text, a layout word (sidebar, widget, ...) also where the element itself holds most of it and has prose. A header inside an article or main belongs to it.

The work is linear in the page: elements are numbered in page order, so each pass goes once over elements or lines.

Defined cases: null and empty html give an empty text; a page without markup is one line of text; a very long page is read like any
other, whatever its nesting; unclosed and misnested tags are tolerated (an end tag without a start, or of an inline element across a block, is ignored; an
element that may not nest closes its like); a page whose only text is boilerplate gives an empty text; rows may repeat, ids and urls may be null; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.workers import tidy

#: Elements by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown as such.
MUTE = frozenset("head title script style noscript template select textarea iframe object embed svg canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav footer menu button input label fieldset dialog search".split())
#: Boilerplate, unless articles inside hold most of the seeds' text.
EXCUSABLE = frozenset("form header aside".split())
#: Blocks that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "p dt dd li option tr td th thead tbody tfoot div h1 h2 h3 h4 h5 h6 ul ol table section article main blockquote footer header nav aside form pre".split()
)
#: What a start tag closes besides an open paragraph.
LIKE = {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body article main div section center blockquote table tbody tr td details figure form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus topnav "
    "breadcrumb breadcrumbs sidebar sidebars aside rail footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget "
    "widgets toolbar pagination pager copyright legal login skip".split()
)
#: Those that also name a part of the layout, which may hold the text.
LAYOUT = frozenset("sidebar sidebars aside rail widget widgets header masthead banner notice alert overlay modal legal promo".split())
#: Those that hold for an article or main element too, and are never excused.
OWN_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Words beside a mark that leave a name's meaning: siteMenu is a menu, page-header or has-sidebar is not known to be boilerplate.
NEUTRAL = frozenset("site main top left right bottom primary secondary global block box list section container wrapper bar area".split())

SIGMA = 1.0
#: The share of the seeds' text that makes an element the region, or excuses it.
MOST, NEARLY_ALL = 0.5, 0.9
#: Characters outside links that make a line prose.
PROSE = 80

_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--\s*>")


def _names(value: str | None) -> list[set[str]]:
    """The words of each class or id name in an attribute's value."""
    return [{w.lower() for w in _NAME.findall(_CAMEL.sub(" ", token))} for token in (value or "").split()]


class Page(HTMLParser):
    """The page's elements, numbered in page order, and its lines as pieces of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.name, self.parent = [""], [-1]
        self.mute, self.shut, self.link, self.held = [False], [False], [False], [False]  # held: inside an article or main
        self.marks: dict[int, set[str]] = {}  # boilerplate words of elements named by nothing else; none for an excusable element
        self.open = [0]
        self.blocks: list[int] = []  # depths of the open block elements
        self.depths: dict[str, list[int]] = {}  # and of all open elements by name
        self.text: list[tuple[str, int]] = []  # text, number of its element
        self.tags = 0
        self.lines: list[tuple[list[tuple[str, int]], int]] = []

    def _end_line(self) -> None:
        if self.text:
            self.lines.append((self.text, self.tags))
        self.text, self.tags = [], 0

    def _cut(self, depth: int) -> None:
        """Close the open elements from a depth on."""
        for number in reversed(self.open[depth:]):
            self.depths[self.name[number]].pop()
        del self.open[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def _close_implied(self, tag: str) -> None:
        like = LIKE.get(tag, ("p",))
        while self.blocks and self.name[self.open[self.blocks[-1]]] in like:
            self._cut(self.blocks[-1])

    def _judge(self, number: int, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Note whether the element is boilerplate by role, or by its names."""
        if tag in ("html", "body"):
            return
        inside = self.held[number]
        marks = OWN_MARKS if tag in ("article", "main") else frozenset() if tag in HEADINGS or tag == "p" and inside else MARKS
        for name, value in attrs:
            if name in ("class", "id"):
                for words in _names(value):
                    if words & marks and words <= marks | NEUTRAL:
                        self.marks.setdefault(number, set()).update(words & marks)
            elif name == "role" and (value or "").strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                self.shut[number] = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag in ENDS_PARAGRAPH:
                self._close_implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        above, number = self.open[-1], len(self.name)
        self.name.append(tag)
        self.parent.append(above)
        self.mute.append(self.mute[above] or tag in MUTE)
        self.shut.append(self.shut[above] or tag in BOILERPLATE)
        self.link.append(self.link[above] or tag == "a")
        self.held.append(self.held[above] or self.name[above] in ("article", "main"))
        if tag in EXCUSABLE and not (tag == "header" and self.held[number]):
            self.marks[number] = set()
        if attrs:
            self._judge(number, tag, attrs)
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(number)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style", "textarea", "title", "iframe", "noscript"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        depth = self.depths.get(tag)
        if depth and (tag in BLOCKS or not self.blocks or self.blocks[-1] < depth[-1]):
            self._cut(depth[-1])

    def handle_data(self, data: str) -> None:
        if not self.mute[self.open[-1]]:
            self.text.append((data, self.open[-1]))

    def close(self) -> None:
        super().close()
        self._end_line()

    def read(self, dropped: set[int]) -> Reading:
        """The lines outside the dropped elements."""
        return Reading(self, self.down([s or k in dropped for k, s in enumerate(self.shut)]))

    def down(self, own: list[bool]) -> list[bool]:
        """Which elements have the property or are inside one that has it."""
        out = list(own)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def up(self, own: list[float]) -> list[float]:
        """For each element the sum over it and all elements inside."""
        out = list(own)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


class Reading:
    """Lines with text, their seeds, and the seeds' text in each element."""

    def __init__(self, page: Page, gone: list[bool]):
        self.page = page
        self.text: list[str] = []
        self.at: list[int] = []  # number of the line's innermost element
        ratio: list[float] = []  # of all lines, those without text left too: they are the neighbours of the others
        own: list[int] = []
        prose: list[int] = []
        for pieces, tags in page.lines:
            kept = [(t, k) for t, k in pieces if not gone[k]]
            free = len(_WHITE.sub(" ", "".join(t for t, k in kept if not page.link[k])).strip())
            text = _WHITE.sub(" ", "".join(t for t, _ in kept)).strip()
            if text:
                own.append(len(ratio))
                self.text.append(text)
                self.at.append(next(k for t, k in reversed(kept) if t.strip()))
                prose.append(free)
            if text or any(t.strip() for t, _ in pieces):
                ratio.append(math.log1p(free / max(1, tags)))
        seeds, alone = _seeds(np.array(ratio))
        self.seeds, self.alone = seeds[own], alone[own]
        sums, longest = [0.0] * len(page.name), [0.0] * len(page.name)
        for text, at, seed, n in zip(self.text, self.at, self.seeds, prose, strict=True):
            if seed:
                sums[at] += len(text)
            if n >= PROSE:
                longest[at] = 1.0
        self.weight = page.up(sums)
        self.prose = page.up(longest)

    def regions(self, kind: tuple[str, ...], but: set[int]) -> list[int]:
        """The outermost elements of a kind that hold seeds."""
        page = self.page
        mine = [n in kind and k not in but for k, n in enumerate(page.name)]
        inside = page.down(mine)
        return [k for k, own in enumerate(mine) if own and not inside[page.parent[k]] and self.weight[k]]


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with weights renormalised at the ends."""
    if sigma <= 0 or len(ratios) < 2:
        return ratios
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The point between two clusters of the values (one-dimensional two-means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        cut = (low + high) / 2
        upper = values > cut
        if upper.all() or not upper.any():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _seeds(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have text of their own and are over the threshold of the smoothed ratios, and which of them are without their neighbours too.

    Prose is over the threshold where two clusters of prose would part there; all lines with text are seeds if no line is over it.
    """
    if not len(ratio):
        return np.zeros(0, bool), np.zeros(0, bool)
    even = smooth(ratio)
    cut = min(threshold(even), math.log1p(PROSE))
    seeds = (even >= cut) & (ratio > 0)
    if not seeds.any():
        seeds = ratio > 0 if (ratio > 0).any() else np.ones(len(ratio), bool)
    return seeds, seeds & (ratio >= cut)


def _dropped(page: Page) -> set[int]:
    """Elements that go by their names, or as forms, headers and asides, after the seeds excused what holds the text."""
    whole = page.read(set())
    most = MOST * whole.weight[0]
    inner = [0.0] * len(page.name)
    for k in whole.regions(("article", "main"), {k for k, words in page.marks.items() if words & OWN_MARKS}):
        inner[k] = whole.weight[k]
    inner = page.up(inner)
    out = set()
    for k, words in page.marks.items():
        wrapper = inner[k] > most
        layout = words and words <= LAYOUT and whole.weight[k] > most and whole.prose[k]
        if words & OWN_MARKS or not (wrapper or layout):
            out.add(k)
    return out


def _kept(page: Page, got: Reading) -> list[bool]:
    """Which lines are content."""
    total = got.weight[0]
    for kind in ("article", "main"):
        found = got.regions((kind,), set())
        if found and sum(got.weight[k] for k in found) > MOST * total:
            at = set(found)
            beside = [False] * len(page.name)
            stray = np.zeros(len(got.text), bool)
            break
    else:
        # shares over a half form a chain, so the last in page order is the innermost
        root = max((k for k, w in enumerate(got.weight) if w >= NEARLY_ALL * total and page.name[k] in CONTAINERS), default=0)
        at, around, k = {root}, set(), root
        while k >= 0:
            around.add(k)
            k = page.parent[k]
        beside = [page.parent[k] in around and (n == "p" or n in HEADINGS) for k, n in enumerate(page.name)]
        stray = got.alone
    inside = page.down([k in at for k in range(len(page.name))])
    card = page.down([n == "article" and not got.weight[k] and k not in at for k, n in enumerate(page.name)])
    beside = page.down(beside)
    return [bool(seed) or beside[k] or inside[k] and not card[k] for k, seed in zip(got.at, stray, strict=True)]


def _tamed(html: str) -> str:
    """The page without what makes the standard parser fail or look for the same missing end again and again.

    Text after the last ``>`` holds no tag, a comment begun after the last comment's end has none, and a marked section is a comment up to ``>``.
    """
    html = html.replace("<![", "<! [")
    last = html.rfind(">") + 1
    html, tail = html[:last], html[last:].replace("<", "&lt;")
    if "<!--" in html:
        end = max((m.end() for m in _COMMENT_END.finditer(html)), default=0)
        html = html[:end] + re.sub(r"<!-+", " ", html[end:])
    return html + tail


def extract(html: str | None) -> str:
    """The page's main text, blocks joined by one line feed."""
    if not html:
        return ""
    page = Page()
    page.feed(_tamed(html))
    page.close()
    got = page.read(_dropped(page) if page.marks else set())
    return "\n".join(t for t, keep in zip(got.text, _kept(page, got), strict=True) if keep)


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Return ``page_id, url, text`` for every row of ``pages``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(tidy(work), "page_id long, url string, text string")
