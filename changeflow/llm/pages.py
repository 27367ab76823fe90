"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. Where a block stands (elements, roles, classes), its length, its links and its wording give
costs for calling it content or boilerplate: the capacities to the two ends of a graph. Blocks that follow one another, and
blocks next to each other under one parent, are tied by edges that are the stronger the closer they stand in the document
tree; an edge across the border of a marked part, such as a menu, is weak. The minimum cut is the labelling with least
cost overall, so a short paragraph among long ones stays and a stray sentence in a menu goes.

Names of classes and ids are read part by part (`comment-list`, `commentList` and `commentlist` alike). A mark by name on an element
that holds most of the page's text and its first heading is a small cost only: a page may stand in a `form` or beside a `sidebar`.
What an element inherits is kept with it while the page is read, so the time grows with the page and not with its depth.

Pages do not depend on each other; they are labelled in the scan that reads them, without a shuffle.

Results in odd cases: NULL and empty html give an empty text. Tags left open are closed where the next block of the kind begins or at the
end; end tags without a start are passed over. Scripts, styles, templates, controls and comments never count as text.
Repeated rows each get their row; further input columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.mincut import sides

# Elements of HTML by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style template noscript title svg annotation annotation-xml canvas iframe object audio video select textarea button input option datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINERS = frozenset("table ul ol dl menu article section div body html aside nav footer header main form".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus"
    " footer footnav form gdpr header login masthead menu menus meta modal nav navbar navigation newsletter notice notices notification pager pagination popup"
    " promo promotion recommended related replies reply respond reviews share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " tags toc toolbar topbar widget widgets".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
NOT_ABOUT = frozenset("has is no not with without".split())
#: Names that mark what they stand before as well: `comment-list`, `ad-slot`, `sidebar-left`.
OWNERS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu menus nav"
    " navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply share sharing sidebar signup social"
    " sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
STRUCTURE = frozenset(
    "area articles author bar block body bottom box button buttons card cards col column container content date frame group heading holder icons inner item"
    " items label layer left line link links list lists main message meta middle module outer overlay panel placeholder post posts primary region right row"
    " secondary section slot space stories strip text thread title top tree unit units wrap wrapper zone".split())
#: Names that say little about an element with most of the page's text.
LOOSE = frozenset("copyright disclaimer form header login meta modal reviews skip tags toc".split())
#: First parts of names that carry a topic, and words of names made from titles.
TOPICS, TITLES = frozenset("category tag topic".split()), frozenset("a and for how in of on the to what why".split())
NOTICE = re.compile(r"cookies?\b|all rights reserved|©|privacy policy|terms of (use|service)|subscribe|sign up|log in|advertisement", re.I)

MARKED, LOOSELY, SCALE = 8.0, 0.5, 1000
_BROKEN = re.compile(r"<[!/?a-zA-Z]")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_JOINED = re.compile(r"(advert|comment|cookie|footer|navbar|newsletter|sidebar|sponsor|widget)s?(" + "|".join(sorted(STRUCTURE)) + ")")
# What a mark holds for in a page: always, unless most of the text and the first heading stand in it, or unless most of the text does.
ALWAYS, LEADING, LOOSELY_NAMED = 0, 1, 2


def _named(name: str, inside: bool) -> tuple[float, int]:
    """What a class or an id says about the text in an element, and when it holds."""
    parts = [x.lower() for x in _NAMES.findall(name)]
    if not parts or parts[0] in TOPICS or NOT_ABOUT.intersection(parts) or len(parts) > 2 and TITLES.intersection(parts):
        return 0.0, ALWAYS
    # The last part says what a thing is; the parts before it, what it belongs to.
    last = parts[-1]
    if last in BOILERPLATE_NAMES:
        if last in ("header", "meta") and (inside or CONTENT_NAMES.intersection(parts[:-1])):
            return 0.0, ALWAYS
        return -MARKED, LOOSELY_NAMED if last in LOOSE else LEADING
    owner = next((i for i in range(len(parts) - 1, -1, -1) if parts[i] not in STRUCTURE), -1)
    if owner >= 0 and "content" not in parts[:owner] and (parts[owner] in OWNERS or _JOINED.fullmatch(parts[owner])):
        return -MARKED, LEADING
    return (2.0 if last in CONTENT_NAMES else 0.0), ALWAYS


def _place(tag: str, attributes: dict[str, str | None], inside: bool) -> tuple[float, int]:
    """What an element's own markup says about the text in it (above 0 content, below 0 boilerplate), and when it holds."""
    if tag in ("html", "body"):
        return 0.0, ALWAYS
    role = (attributes.get("role") or "").lower()
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside or role in BOILERPLATE_ROLES:
        return -MARKED, LEADING if tag in ("form", "dialog") else ALWAYS
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return -MARKED, ALWAYS
    value = 3.0 if tag in CONTENT_TAGS or role in ("main", "article") else 0.0
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        own, holds = _named(name, inside)
        if own < 0:
            return own, holds
        value = max(value, own)
    return value, ALWAYS


class _Mark:
    """An element marked as boilerplate: the mark around it, when it holds, the text in it, whether a first heading stands in it."""

    __slots__ = ("above", "holds", "chars", "leads", "cost")

    def __init__(self, above: _Mark | None, holds: int):
        self.above, self.holds, self.chars, self.leads, self.cost = above, holds, 0, False, MARKED


class _Blocks(HTMLParser):
    """Blocks of a page: (text, share of it in links, element, content by markup, mark around it, places of its parents)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, float, _Mark | None, bool, int]] = []
        #: Places in `open` of the elements of each tag, of those that are blocks, and of containers.
        self.where: dict[str, list[int]] = {}
        self.levels: list[int] = []
        self.walls: list[int] = []
        self.marks: list[_Mark] = []
        self.blocks: list[tuple[str, float, str, float, _Mark | None, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.count = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            block = self.levels[-1] if self.levels else -1
            tag, good, mark = (self.open[block][0], self.open[-1][1], self.open[-1][2]) if block >= 0 else ("", 0.0, None)
            parents = tuple(x[4] for x in self.open[max(0, block - 3) : max(0, block)][::-1] if x[0] in BLOCKS)
            self.blocks.append((text, min(1.0, self.linked / len(text)), tag, good, mark, parents))
            if mark:
                mark.chars += len(text)
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        if self.levels and self.levels[-1] >= depth:
            self.flush()
        while len(self.open) > depth:
            tag = self.open.pop()[0]
            self.where[tag].pop()
            self.links -= tag == "a"
            self.hidden -= tag in NO_TEXT
        for places in (self.levels, self.walls):
            while places and places[-1] >= depth:
                places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            # An open paragraph ends where a block begins; items and cells end where the next one begins.
            wall = self.walls[-1] if self.walls else -1
            ended = [at for x in ("p", *CLOSES.get(tag, ())) for at in self.above(x, wall, first=tag in CLOSES)]
            if ended:
                self.close_to(min(ended))
        if tag in VOID:
            if tag in ("br", "hr") and not self.hidden:
                self.parts.append(" ")
            return
        good, mark, inside = self.open[-1][1:4] if self.open else (0.0, None, False)
        own, holds = _place(tag, dict(attrs), inside)
        if own < 0:
            mark = _Mark(mark, holds)
            self.marks.append(mark)
        if mark and tag in ("h1", "main"):
            mark.leads = True
        self.count += 1
        place = len(self.open)
        self.where.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.levels.append(place)
        if tag in CONTAINERS:
            self.walls.append(place)
        self.open.append((tag, max(good, own), mark, inside or tag in CONTENT_TAGS, self.count))
        self.links += tag == "a"
        self.hidden += tag in NO_TEXT

    def above(self, tag: str, wall: int, first: bool) -> list[int]:
        """The place of the last open element of a tag above a container, or of the first one."""
        places = self.where.get(tag) or [-1]
        if places[-1] <= wall:
            return []
        return [places[bisect_right(places, wall)] if first else places[-1]]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        wall = self.walls[-1] if self.walls and tag not in CONTAINERS else -1
        for place in self.above(tag, wall, first=False):
            self.close_to(place)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def weigh(self) -> None:
        """Gives each mark its cost, when the whole page is read."""
        for mark in reversed(self.marks):  # a mark is made before those in it
            if mark.above:
                mark.above.chars += mark.chars
                mark.above.leads |= mark.leads
        total = sum(len(block[0]) for block in self.blocks)
        for mark in self.marks:
            most = 2 * mark.chars > total
            own = LOOSELY if most and (mark.holds == LOOSELY_NAMED or mark.holds == LEADING and mark.leads) else MARKED
            mark.cost = max(own, mark.above.cost if mark.above else 0.0)


def _preference(block: tuple[str, float, str, float, _Mark | None, tuple[int, ...]]) -> float:
    """Cost of calling a block boilerplate, less that of calling it content."""
    text, linked, tag, good, mark, _ = block
    n = text.count(" ") + 1
    value = good - (mark.cost if mark else 0.0) + min(1.5, n / 20) - 3 * linked - 0.4 + 0.6 * (tag in HEADINGS) + 0.3 * (text[-1] in ".!?")
    return value - 1.5 * (good <= 0 and n < 40 and bool(NOTICE.search(text)))


def main_blocks(html: str | None) -> tuple[list[str], int]:
    """The content blocks of a page in order, and how many blocks it has."""
    parser = _Blocks()
    parser.feed(html or "")
    # A tag or comment that the page breaks off in is no text.
    if _BROKEN.match(parser.rawdata):
        parser.rawdata = ""
    parser.close()
    parser.flush()
    parser.weigh()
    blocks = parser.blocks
    bad = [block[4] is not None and block[4].cost >= MARKED for block in blocks]
    edges, last = [], {}
    for i, block in enumerate(blocks):
        parents = block[5]
        if i:
            before = blocks[i - 1]
            shared = next((k for k, x in enumerate(parents) if x in before[5]), 3)
            edges.append((i - 1, i, 50 if bad[i - 1] != bad[i] else (800, 500, 300, 150)[shared]))
        if parents:
            # The block before under the same parent, with something else in between.
            sibling = last.get(parents[0])
            if sibling is not None and sibling < i - 1 and bad[sibling] == bad[i]:
                edges.append((sibling, i, 400))
            last[parents[0]] = i
    labels = sides([round(_preference(block) * SCALE) for block in blocks], edges)
    return [block[0] for block, content in zip(blocks, labels, strict=True) if content], len(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, blocks, kept = [], [], []
        for html in batch.column("html"):
            found, n = main_blocks(html.as_py())
            texts.append("\n".join(found)), blocks.append(n), kept.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks and n_kept."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_blocks long, n_kept long")
