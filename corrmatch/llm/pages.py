"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams each page.  Block elements cut it into lines;
a line's ratio is its characters (link texts aside) over its tags.  Lines within
elements that are never article text (menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) have ratio 0 and no text.
An element's name counts as a whole class or id, but for known affixes; it says nothing
of a main element within, of headings and of inline elements, and what names leave out
(on pages with articles: articles within named elements) is taken where it outweighs the rest.  The ratios are smoothed
by a Gaussian, and a threshold between two clusters of the smoothed values (two-means)
marks content lines.  The result is the smallest region (section, division, cell, page)
that holds all marked lines, whole: a short line of an article is as much of it as a
long one.  Only ``MENU`` or more unmarked lines in a row that are all links are a menu, and
left out.  On a page with article or main elements that have text, those are the
result, all of them.

Defined cases: a null or empty page, and one without text, has the text '' and 0
characters; unclosed and wrongly nested tags close as browsers close them, in the
main; rows are independent, so copies, ties and clashing columns have no effect.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import column, per_batch, read, texts_of

CHUNK = 1 << 16
SIGMA = 1.0
#: Lines of nothing but links that make a menu.
MENU = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split()
)
#: Elements whose text is never the article's.
_NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea fieldset iframe object canvas svg math audio video dialog menu datalist".split()
)
_REGIONS = frozenset("section div td th body html".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark an element as no part of the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices alert banner popup modal newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond related recommended share sharing social pagination pager toolbar widget".split()
)
#: Names of reader comments, which hold articles of their own.
_REPLIES = frozenset("comment comments commentlist disqus".split())
#: Words that may stand beside those names in a class or id without changing its sense.
_AFFIXES = frozenset(
    "site main global top bottom left right primary secondary upper lower mobile desktop sticky fixed inner outer box bar block body container content "
    "wrapper wrap area region panel row col column list section item items link links button buttons icons posts articles stories form message text "
    "unit slot overlay modal dialog thread js is ui".split()
)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_HEADERS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How far a line is left out: not, as an article in an element left out by its name, by such a name, by one of replies, always.
_CLEAN, _HELD, _DOUBT, _REPLY, _OUT = range(5)
_LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _matched(attrs: list[tuple[str, str | None]], names: frozenset[str]) -> bool:
    """Whether a whole class or id is one of ``names``, but for known affixes and digits."""
    for name, value in attrs:
        if value and name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if any(w in names for w in words) and all(w in names or w in _NAMES or w in _AFFIXES for w in words):
                    return True
    return False


def _left_out(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> int:
    """How far an element's own tag and attributes leave it out."""
    if tag in _NEVER or tag == "header" and not article:
        return _OUT
    if any(n == "role" and v and v.strip().lower() in _ROLES for n, v in attrs):
        return _OUT
    if tag in _INLINE or tag in _HEADINGS or tag in ("html", "body"):
        return _CLEAN
    if _matched(attrs, _REPLIES):
        return _REPLY
    return _DOUBT if _matched(attrs, _NAMES - _HEADERS if article else _NAMES) else _CLEAN


class _Lines(HTMLParser):
    """Collects (text, length without links, tags, region, how far left out, whether in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        # tag, how far left out, region, in an article
        self.open: list[tuple[str, int, int, bool]] = [("", _CLEAN, 0, False)]
        self.around = [0]  # the region around each region
        self.links = 0
        self.parts: list[str] = []
        self.linked, self.tags = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        _, out, region, article = self.open[-1]
        if text or self.tags:
            self.lines.append((text, max(0, len(text) - self.linked), self.tags, region, out, article))
        self.parts, self.linked, self.tags = [], 0, 0

    def pop(self, at: int) -> None:
        while len(self.open) > at:
            if self.open.pop()[0] == "a":
                self.links -= 1

    def handle_starttag(self, tag, attrs):
        block = tag not in _INLINE and tag != "br"
        if block:
            self.flush()
            for at in range(len(self.open) - 1, 0, -1):  # a block ends an open paragraph
                if self.open[at][0] == "p":
                    self.pop(at)
                elif self.open[at][0] not in _INLINE:
                    break
            if tag in _LISTS:
                for at in range(len(self.open) - 1, 0, -1):
                    if self.open[at][0] == tag or {self.open[at][0], tag} == {"dt", "dd"} or {self.open[at][0], tag} == {"td", "th"}:
                        self.pop(at)
                        break
                    if self.open[at][0] in _LISTS[tag]:
                        break
            if self.open[-1][0] == "head" and tag not in _NEVER and tag not in ("title", "meta", "link", "base"):
                self.pop(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self.links += 1
        _, out, region, article = self.open[-1]
        main = tag in ("article", "main") or any(n == "role" and v in ("main", "article") for n, v in attrs)
        own = _left_out(tag, attrs, article)
        if main:  # the name of an element does not tell against an article in it
            only = tag == "main" or ("role", "main") in attrs
            own = own if own == _OUT or own == _REPLY and not only else _CLEAN
            out = _CLEAN if only and not article and out < _OUT else _HELD if not article and out == _DOUBT else out
        if main or tag in _REGIONS:
            self.around.append(region)
            region = len(self.around) - 1
        out = max(out, own)
        self.open.append((tag, out, region, article or main and out < _REPLY))

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag not in _INLINE:
            self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.pop(at)
                break
            if tag in _INLINE and self.open[at][0] not in _INLINE:
                break  # an inline end tag ends nothing outside its block
        self.tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "math", "path", "rect"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.open[-1][1] < _REPLY:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian window of three sigma, normalised at the ends."""
    r = int(np.ceil(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratios, window)[r:-r] / np.convolve(np.ones(len(ratios)), window)[r:-r]


def threshold(values: np.ndarray) -> float:
    """Half way between the means of two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values > (low + high) / 2
        if upper.all() or not upper.any():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _path(around: list[int], region: int) -> list[int]:
    """The regions from the whole page, 0, to ``region``."""
    out = [region]
    while out[-1]:
        out.append(around[out[-1]])
    return out[::-1]


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by one space."""
    parser = _Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    if parser.rawdata.startswith(("<!", "<?")):  # an unclosed comment hides the rest
        parser.rawdata = ""
    parser.close()
    parser.flush()
    lines = [x for x in parser.lines if x[0] or x[2]]
    # what names leave out is taken where it outweighs all else
    size = [sum(n for _, n, _, _, out, _ in lines if out == level) for level in range(_OUT)]
    article = any(x[0] and x[5] and x[4] <= _HELD for x in lines)
    most = (_HELD if size[_HELD] > size[_CLEAN] else _CLEAN) if article else (_DOUBT if size[_DOUBT] > size[_CLEAN] else _CLEAN)
    # (text, ratio, region, in an article)
    lines = [(t, n / max(1, tags), r, within) if out == _CLEAN or out == most else ("", 0.0, r, False) for t, n, tags, r, out, within in lines]
    if not any(x[0] for x in lines):
        return ""
    if any(x[0] and x[3] for x in lines):
        return " ".join(x[0] for x in lines if x[0] and x[3])
    ratios = np.array([x[1] for x in lines])
    values = smooth(ratios)
    marked = (values >= threshold(values)) & (ratios > 0)
    if not marked.any():  # texts of links only
        marked = np.array([bool(x[0]) for x in lines])
    paths = {r: _path(parser.around, r) for r in {x[2] for x in lines}}
    common = paths[next(x[2] for x, m in zip(lines, marked) if m)]
    for r in {x[2] for x, m in zip(lines, marked) if m}:
        common = [a for a, b in zip(common, paths[r]) if a == b]
    kept = [i for i, x in enumerate(lines) if x[0] and common[-1] in paths[x[2]]]
    menu = _menus([bool(lines[i][1]) or marked[i] for i in kept])
    return " ".join(lines[i][0] for i, out in zip(kept, menu) if not out)


def _menus(own: list[bool]) -> list[bool]:
    """Which lines stand in a run of ``MENU`` or more that have no text of their own; not all of them."""
    out, at = [False] * len(own), 0
    while at < len(own):
        end = at
        while end < len(own) and not own[end]:
            end += 1
        if end - at >= MENU and any(own):
            out[at:end] = [True] * (end - at)
        at = end + 1
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batch):
        got = [main_text(h) for h in texts_of(batch, "html")]
        return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": got, "n_chars": [len(t) for t in got]}

    return per_batch(pages.select("page_id", "url", "html"), rows, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
