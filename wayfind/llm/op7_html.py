"""Main text of web pages from parser events, by smoothed text-to-tag ratios.

The standard library's parser is fed in pieces and gives a stream of events. They make
*lines*, one for each block of running text, with the number of tags met in it, the share
of its text in links, and the container it stands in. The text-to-tag ratios of the
lines are smoothed by a Gaussian kernel in page order; lines above a threshold (half the
deviation above the mean of the logarithms, but at most the mean of the best half) are
clustered, and the clusters select the region:

* the ``article`` or ``main`` with the greatest mass of smoothed ratios, if it has a share worth
  the name (``LEAST_SHARE``), or else
* the smallest container that holds ``MOST_SHARE`` of the clusters' text.

All lines of that region are kept in page order, short ones too. Where the region is no element
of its own choosing but the page as a whole, it goes from the first to the last line of the clusters.
Without an article or main, of the region's lines those go that are mostly links and don't adjoin
a cluster; beyond it, lines of the clusters stay where their container's mean ratio is at least half
of the region's. Names only forbid: what stands in
containers that are never content by their element, role, class or id (navigation, headers, footers,
sidebars, notices, adverts, forms, comments) counts as without text. A class or id
doesn't forbid what holds the page's largest article or main, nor a page as a whole.

Defined results: null, empty or textless pages have an empty text. An empty table gives no rows. Very long
and very deeply nested pages take time and memory in proportion to their length. Of regions
that tie, an article comes before a main, and then the one that begins later. Character references
are decoded; white space inside a block is one space; blocks are joined by two line feeds.
Unclosed elements end with their container. Repeated rows give equal rows; a page_id may
be null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
SIGMA = 1.5
LEAST_SHARE, MOST_SHARE = 0.3, 0.75
ALIKE = 0.5  # of the region's mean ratio

# fixed values: elements of HTML, by what they mean for running text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset("script style noscript template svg math iframe object audio video canvas select option button textarea datalist head title".split())
NEVER = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD_NAMES = re.compile(
    r"(?:^|(?<!\bno)(?<!\bwith)(?<!\bhas)(?<!\bwithout)[-_ ])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|widget\w*|comments?|commentlist|disqus\w*|respond|replies|reply|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|breadcrumbs?|menu\w*|nav\w*|navbar|pagination|pager|toolbar|header|masthead|footer\w*|copyright|skip\w*|toc|tags|byline-ad)(?:$|[-_ ])",
    re.IGNORECASE,
)


class Lines(HTMLParser):
    """Collects the lines of a page. Containers are numbered as they open, so those inside one have the numbers up to ``last`` of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # container, number, whether it or one around it is never content by its element or role
        self.mute: list[str] = []
        self.link = 0
        self.text: list[str] = []
        self.linked = self.tags = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, linked characters, container, never
        self.kinds, self.last, self.named = [""], [0], [False]  # by number; 0 is the page; named: by class or id never content

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            inside = self.stack[-1] if self.stack else ("", 0, False)
            self.lines.append((text, self.tags, self.linked, inside[1], inside[2]))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self.mute:
            self.end_line()  # the tag counts for the line that it begins
        self.tags += 1
        if self.mute:
            if tag == self.mute[-1] and tag not in VOID:
                self.mute.append(tag)
            return
        if tag == "body":
            self.mute = []
        if tag in MUTE:
            if tag in ("head", "title", "option"):
                self.end_line()
            if tag != "head":  # what a head shows is muted by itself, and it may never be closed
                self.mute.append(tag)
            return
        if tag in BLOCK:
            self.link = 0
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.link = 1
        if tag in CONTAINER:
            if tag in ("li", "td", "th", "tr"):
                self.close(tag, self.bound(tag))
            said = {k: v or "" for k, v in attrs}
            never = tag in NEVER or said.get("role", "").lower() in ROLES or said.get("aria-hidden") == "true" or "hidden" in said
            self.named.append(tag not in ("html", "body") and bool(BAD_NAMES.search(said.get("class", "")) or BAD_NAMES.search(said.get("id", ""))))
            self.kinds.append("main" if tag == "main" or said.get("role", "").lower() == "main" else tag)
            self.last.append(0)
            self.stack.append((tag, len(self.last) - 1, never or bool(self.stack) and self.stack[-1][2]))

    def bound(self, tag: str) -> tuple[str, ...]:
        """What an unclosed element of this kind ends before."""
        return ("table",) if tag in ("td", "th", "tr") else ("ul", "ol", "menu")

    def end(self, depth: int) -> None:
        for x in self.stack[depth:]:
            self.last[x[1]] = len(self.last) - 1
        del self.stack[depth:]

    def close(self, tag: str, until: tuple[str, ...] = ()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.end(i)
                return
            if self.stack[i][0] in until:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.mute:
            if tag == self.mute[-1]:
                self.mute.pop()
            return
        if tag in BLOCK:
            self.end_line()
        if tag == "a":
            self.link = 0
        if tag in CONTAINER:
            self.close(tag)

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.text.append(data)
            if self.link:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def within(parser: Lines, mass: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By container, the sum of the lines' ``mass`` in it and in all inside; ``at`` is the container of each line."""
    own = np.concatenate([[0.0], np.cumsum(np.bincount(at, mass, len(parser.last)))])
    return own[np.asarray(parser.last) + 1] - own[:-1]


def forbidden(parser: Lines, size: np.ndarray, at: np.ndarray, never: np.ndarray) -> np.ndarray:
    """The lines that stand where no content is, by element or role (``never``) or by name."""
    last, named = np.asarray(parser.last), np.asarray(parser.named)
    plain = [c for c, k in enumerate(parser.kinds) if k in ("article", "main") and not named[c]]
    if plain:
        held = within(parser, np.where(never, 0, size), at)
        top = max(plain, key=lambda c: (held[c], c))
        named = named & ~((np.arange(len(last)) <= top) & (last >= top))
    # a container is forbidden if one that is named so opened before it and is not closed
    edge = np.zeros(len(last) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(named), 1)
    np.add.at(edge, last[named] + 1, -1)
    by_name = (np.cumsum(edge)[:-1] > 0)[at]
    return never if (never | by_name).all() else never | by_name


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    HTMLParser.close(parser)  # our own close() ends elements
    parser.end_line()
    parser.end(0)
    parser.last[0] = len(parser.last) - 1
    lines = parser.lines
    if not lines:
        return ""
    size, tags, linked = np.array([(len(x[0]), x[1], x[2]) for x in lines], float).T
    at = np.array([x[3] for x in lines])
    never = forbidden(parser, size, at, np.array([x[4] for x in lines]))
    if never.all():
        return ""
    ratio = np.where(never, 0, np.log1p(np.maximum(size - linked, 0) / np.maximum(tags, 1)))
    even = smooth(ratio)
    best_half = np.sort(even)[len(even) // 2 :]
    cluster = (even >= min(even.mean() + 0.5 * even.std(), best_half.mean()) - 1e-9) & ~never
    if not cluster.any():
        cluster = ~never
    mass = within(parser, np.where(never, 0, np.maximum(even, 0)), at)
    own = [c for c, k in enumerate(parser.kinds) if k in ("article", "main") and mass[c] > 0]
    if own and max(mass[c] for c in own) >= LEAST_SHARE * mass[0]:
        best = max(own, key=lambda c: (mass[c], parser.kinds[c] == "article", c))
        keep = (at >= best) & (at <= parser.last[best])
    else:
        text = within(parser, np.where(cluster, size, 0), at)
        best = int(np.flatnonzero(text >= MOST_SHARE * text[0] - 1e-9)[-1])  # the innermost: containers are numbered from outside in
        inside = (at >= best) & (at <= parser.last[best])
        near = np.convolve(cluster, [1, 1, 1])[1:-1] > 0
        if parser.kinds[best] in ("", "html", "body"):
            ends = np.flatnonzero(cluster)
            inside &= (np.arange(len(lines)) >= ends[0]) & (np.arange(len(lines)) <= ends[-1]) | near
        # beyond the region, containers whose clustered lines have text for a tag like the region's own
        plain = np.expm1(ratio)
        mean = np.bincount(at, plain * cluster, len(parser.last)) / np.maximum(np.bincount(at, cluster, len(parser.last)), 1)
        alike = mean[at] >= ALIKE * plain[cluster & inside].mean()
        keep = cluster & alike & ~inside | inside & (near | (2 * linked < size))
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(keep & ~never))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
