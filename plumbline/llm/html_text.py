"""Main text of web pages by text-to-tag ratio.

1. The standard library's parser streams events. Each block element, list item, cell or line break begins a line; a line
   collects its text and counts its tags and the characters inside links. Scripts, styles and other unseen content are skipped by their events.
2. The text-to-tag ratio of a line is its characters over its tags (one at least). Gaussian smoothing over neighbouring lines
   evens it out, and lines at or over a threshold (the smaller of mean and standard deviation) are the content cluster.
   Lines under boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, comments; by element, role or
   class) never join it. A class speaks for its element by a whole word of one of its names, layout names such as ``has-sidebar`` do not, and
   no class strikes an element that holds the article or nearly all text.
3. The content region is the smallest container element that holds most of the cluster, widened to the article or main element around it.
   Inside the region the cluster decides as well: lines of nothing but links whose smoothed ratios stay below the threshold together
   are lists of links and go. Other short lines (headings, one-word paragraphs) belong to the region. Cluster lines outside stay only
   if the page has no article or main element.

White space inside a line becomes one space, lines are joined by one space in page order. A row is worked on where it is read:
no shuffle, memory holds a few pages. The work grows with the length of a page alone, however its elements are nested or left open.

Edge cases: a null or empty page, and one without text, gives an empty text. Unclosed elements end with their parents. Long
pages are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.session import ship_package

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
                  "thead title tr ul".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video map select textarea button title datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "optgroup"}
MAIN = frozenset(("article", "main"))
CONTAINERS = MAIN | frozenset(("", "html", "body", "div", "section", "td", "center"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words that say what an element is for, as a part of a class or id; those that say so only outside an article; and beginnings of names that
# describe the layout around something.
HINTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
                  "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice alert "
                  "newsletter subscribe popup modal share sharing social related recommended widget pagination pager toolbar login signup copyright".split())
HEADER_HINTS = frozenset(("header",))
PAIRS = frozenset((("side", "bar"), ("more", "stories"), ("more", "posts"), ("more", "articles"), ("read", "more"), ("read", "next")))
LAYOUT = frozenset("has with without no not is in js layout wrap wrapper main content site page body container row col column grid".split())
_PARTS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def hinted(names: str, in_main: bool) -> bool:
    """Whether one of an element's class names or its id says that it is no content."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(_CAMEL.sub("-", name))]
        if any(pair in PAIRS for pair in zip(parts, parts[1:], strict=False)):
            if parts[0] not in LAYOUT:
                return True
        elif parts and (len(parts) == 1 or parts[0] not in LAYOUT) and not HINTS.isdisjoint(parts):
            return True
        elif not in_main and parts and not HEADER_HINTS.isdisjoint(parts):
            return True
    return False


SIGMA = 1.0
RADIUS = 3
MOST = 0.6  # share of the cluster's characters that the region holds
NEARLY_ALL = 0.9  # share of a page's characters that no class can strike
LINK_SHARE = 0.9  # share of a line's characters inside links that makes it one of links
LINK_LINES = 5  # so many together are a list


class _Lines(HTMLParser):
    """Turns parser events into lines: text, tags, characters in links, and the element they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # elements by number; 0 stands for the page. Struck: 0 no, 1 by class, 2 by element or role
        self.parents, self.names, self.struck = [-1], [""], [0]
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]  # name, number, unseen, in an article, links around
        self.depths: dict[str, list[int]] = {}  # where elements of a name are open
        self.blocks: list[int] = [0]  # where blocks other than paragraphs are
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, element, characters in links
        self.text: list[str] = []
        self.tags = self.linked = self.place = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.place, self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def _pop(self, depth: int) -> None:
        for at in range(len(self.open) - 1, depth - 1, -1):
            self.depths[self.open[at][0]].pop()
        del self.open[depth:]
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def _last(self, name: str) -> int:
        """Where the innermost open element of a name is, 0 for none."""
        return (self.depths.get(name) or [0])[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
            self._imply_end(tag)
        _, parent, unseen, in_main, links = self.open[-1]
        number, depth = len(self.names), len(self.open)
        self.parents.append(parent)
        self.names.append(tag)
        struck = 0
        if tag not in ("html", "body", "main"):
            given = dict(attrs)
            marked = " ".join(filter(None, (given.get("class"), given.get("id"))))
            if tag in BOILERPLATE or tag == "header" and not in_main or (given.get("role") or "").lower() in ROLES or "hidden" in given:
                struck = 2
            elif marked and tag != "article" and not (tag == "header" and in_main) and hinted(marked, in_main):
                struck = 1
        self.struck.append(struck)
        self.depths.setdefault(tag, []).append(depth)
        if tag in BLOCK and tag != "p":
            self.blocks.append(depth)
        self.open.append((tag, number, unseen or tag in UNSEEN, in_main or tag in MAIN, links + (tag == "a")))

    def _imply_end(self, tag: str) -> None:
        """An open paragraph ends before a block; an open item ends before its sibling."""
        ends = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,) if tag in ("li", "tr", "option") else ()
        around = self.blocks[-1]
        if around and self.open[around][0] in ends:
            self._pop(around)
        elif tag in CLOSES_P and self._last("p") > around:
            self._pop(self._last("p"))
        elif "option" in ends and self._last("option") > around:
            self._pop(self._last("option"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        depth = self._last(tag)
        if depth and (tag in BLOCK or depth > max(self.blocks[-1], self._last("p"))):  # an inline element ends only in its block
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        _, number, unseen, _, links = self.open[-1]
        if unseen:
            return
        if not self.text:
            self.place = number
        self.text.append(data)
        if links:
            self.linked += len(data.strip())


def lines_of(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; weights beyond the ends are left out and the rest is scaled up."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]


def _boilerplate(page: _Lines) -> np.ndarray:
    """For each element, whether it stands in something that is no content."""
    n = len(page.names)
    weight, holds = np.zeros(n), np.zeros(n, dtype=bool)
    for text, _, place, _ in page.lines:
        weight[place] += len(text)
    for i, name in enumerate(page.names):
        holds[i] = name in MAIN or name == "h1"
    for i in range(n - 1, 0, -1):  # parents have smaller numbers
        weight[page.parents[i]] += weight[i]
        holds[page.parents[i]] |= holds[i]
    out = np.zeros(n, dtype=bool)
    for i in range(1, n):
        struck = page.struck[i] == 2 or page.struck[i] == 1 and not (holds[i] or weight[i] >= NEARLY_ALL * weight[0])
        out[i] = out[page.parents[i]] or struck
    return out


def _link_lists(lines: list[tuple[str, int, int, int]], inside: list[int], ratios: np.ndarray, threshold: float) -> set[int]:
    """Lines of nothing but links that stand together, in number, with smoothed ratios below the threshold on the whole."""
    out: set[int] = set()
    run: list[int] = []
    for i in [*inside, -1]:
        if i >= 0 and lines[i][3] >= LINK_SHARE * len(lines[i][0].replace(" ", "")):
            run.append(i)
            continue
        if len(run) >= LINK_LINES and ratios[run].mean() < threshold:
            out |= set(run)
        run = []
    return out


def main_text(html: str | None) -> str:
    """The main text of a page."""
    page = lines_of(html or "")
    lines = page.lines
    boiler = _boilerplate(page)
    clean = [i for i, x in enumerate(lines) if not boiler[x[2]]]
    if not clean:
        return ""
    ratios = smoothed(np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    threshold = min(ratios.mean(), ratios.std())
    core = [i for i in clean if ratios[i] >= threshold] or clean

    weight = np.zeros(len(page.names))
    for i in core:
        weight[lines[i][2]] += len(lines[i][0])
    for n in range(len(weight) - 1, 0, -1):  # parents have smaller numbers
        weight[page.parents[n]] += weight[n]
    region = max(n for n in range(len(weight)) if weight[n] >= MOST * weight[0] and page.names[n] in CONTAINERS)
    above = region
    while above > 0 and page.names[above] not in MAIN:
        above = page.parents[above]
    has_main = above > 0
    region = above if has_main else region

    inside = np.zeros(len(page.names), dtype=bool)
    inside[region] = True
    for n in range(region + 1, len(inside)):
        inside[n] = inside[page.parents[n]]
    held = [i for i in clean if inside[lines[i][2]]]
    chosen = (set(held) | (set() if has_main else set(core))) - _link_lists(lines, held, ratios, threshold)
    return " ".join(lines[i][0] for i in sorted(chosen))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every page."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            texts = [main_text(h) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             [*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).cast("string"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long")
