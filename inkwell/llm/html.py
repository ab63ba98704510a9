"""Main text of web pages from a stream of parser events and smoothed text-to-tag ratios."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What holds no text of the page.
SKIP = frozenset("head title script style noscript template form button select textarea label iframe object svg canvas map dialog".split())
#: What commonly surrounds the main text, as do marked elements, and by how much its ratios count less; an article's count as much more.
FRAME = frozenset("nav footer aside menu header".split())
PRIOR = 100
#: What begins and ends a line.
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address header hgroup details summary center".split())
#: What lines belong to; a region is chosen or left as a whole.
HOLDER = frozenset("body article main section div td".split())
MAIN = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: Words of class, id and role that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside complementary widget footer contentinfo masthead header cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments reply replies respond discussion disqus reactions copyright legal toolbar pagination pager skip hidden search form".split()
)
#: Those that mark even an article or main element.
OF_MAIN = frozenset("comment comments related reply ad promo sponsored".split())
NOT_WORD = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CUT_TAG = re.compile(r"<[A-Za-z/!?]")
#: Reach of the smoothing, in lines, and its width.
RADIUS = 2
KERNEL = [math.exp(-((i / 1.0) ** 2) / 2) for i in range(-RADIUS, RADIUS + 1)]


def marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role name what is not main text; of elements that hold the page or its main text, only a few such names count."""
    names = [MARKS & set(NOT_WORD.split(v.lower())) for k, v in attrs if k in ("class", "id", "role") and v]
    if tag in ("html", "body"):
        return False
    return any(n & OF_MAIN if tag in MAIN else n for n in names)


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and HIDDEN.search(v.lower()) for k, v in attrs)


@dataclass
class Line:
    text: str
    region: int
    main: int
    framed: bool
    tags: int
    linked: int
    links: int


class Events(HTMLParser):
    """Turns parser events into lines of text, each with its region, its number of tags and its linked characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, bool]] = []  # tag, whether skipped, region, main, whether framed
        self.count: Counter[str] = Counter()  # of open tags, so that stray ends cost nothing
        self.lines: list[Line] = []
        self.regions = 1
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.anchors = 0

    def top(self) -> tuple[str, bool, int, int, bool]:
        return self.open[-1] if self.open else ("", False, 0, 0, False)

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, _, region, main, framed = self.top()
                self.lines.append(Line(text, region, main, framed, self.tags, self.linked, self.links))
                self.tags = self.linked = self.links = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag in FRAME:
            self.end_line()
            self.close_implied(tag)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, skipped, region, main, framed = self.top()
        if not skipped:
            skipped = tag in SKIP or hidden(attrs)
            frames = not framed and (tag in FRAME and not (tag == "header" and main) or marked(tag, attrs))
            if frames and (tag not in BLOCK):
                self.end_line()
            if tag in HOLDER or frames:
                region, self.regions = self.regions, self.regions + 1
            framed = framed or frames
            if tag in MAIN and not main and not framed:
                main = region
            if tag == "a":
                self.anchors += 1
                self.links += 1
        self.open.append((tag, skipped, region, main, framed))
        self.count[tag] += 1

    def close_implied(self, tag: str) -> None:
        """An open p ends where a block begins; an item or cell ends where the next of its kind begins."""
        own = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in CLOSED_BY_BLOCK or name in own:
                self.pop(i)
                return
            if name in BLOCK or name in FRAME or name in SKIP:
                return

    def pop(self, to: int) -> None:
        if self.open[to][4] and not (to and self.open[to - 1][4]):
            self.end_line()
        for tag, skipped, _, _, _ in self.open[to:]:
            self.count[tag] -= 1
            if tag == "a" and not skipped:
                self.anchors = max(0, self.anchors - 1)
        del self.open[to:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in ("script", "style", "svg", "path", "iframe"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in FRAME:
            self.end_line()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.pop(i)
                return
            if name in HOLDER and tag not in HOLDER and tag not in FRAME and tag not in SKIP or name in MAIN and tag not in ("body", "html", *MAIN):
                return  # a stray end of something opened outside

    def handle_data(self, data: str) -> None:
        skipped = self.top()[1]
        if not skipped:
            self.text.append(data)
            if self.anchors:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(lines: list[Line]) -> list[float]:
    """Each line's ratio of unlinked characters to tags under a Gaussian over its neighbours.

    Lines in a frame (FRAME and marked elements) count a PRIOR-th, those in an article or main PRIOR times.
    Neighbours are the nearest lines of the same kind, so that a frame takes nothing from the text beside it.
    """
    out = [0.0] * len(lines)
    kinds = [(x.framed, bool(x.main) and not x.framed) for x in lines]
    for kind in set(kinds):
        at = [i for i, k in enumerate(kinds) if k == kind]
        weight = 1 / PRIOR if kind[0] else PRIOR if kind[1] else 1
        ratio = [weight * max(0, len(lines[i].text) - lines[i].linked) / (1 + lines[i].tags) for i in at]
        for j, i in enumerate(at):
            a, b = max(0, j - RADIUS), min(len(at), j + RADIUS + 1)
            k = KERNEL[a - j + RADIUS : b - j + RADIUS]
            out[i] = sum(x * y for x, y in zip(k, ratio[a:b])) / sum(k)
    return out


def chosen(lines: list[Line]) -> list[Line]:
    """The lines of the content regions.

    Lines whose smoothed ratio reaches the standard deviation of all (or half the mean, if that is more) form
    the content cluster; a tie is in. A region is content if it has one, and is taken whole: short lines within
    it are main text too. The lines of an article or main element are one region. Where none of these is
    content, other unframed regions between content ones and next to them are taken as well, up to the first
    list of links: blocks in elements of their own. A page of frames alone has no main text.
    """
    if all(x.framed for x in lines):
        return []
    smooth = smoothed(lines)
    n = len(lines)
    mean = sum(smooth) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / n)
    least = min(max(spread, mean / 2), max(smooth))
    of = [x.region if x.framed else x.main or x.region for x in lines]
    content = {r for r, s in zip(of, smooth) if s >= least}
    if any(x.main in content for x in lines if x.main):
        return [x for x, r in zip(lines, of) if r in content]
    rest = [(x, r) for x, r in zip(lines, of) if r in content or not x.framed]
    runs = [list(g) for _, g in groupby(rest, key=lambda x: x[1])]
    kinds = ["content" if g[0][1] in content else "linked" if mostly_linked([x for x, _ in g]) else "plain" for g in runs]
    at = 0
    for kind, same in groupby(list(kinds)):
        end = at + len(list(same))
        # one link alone, as an author's, makes no list
        if kind == "linked" and sum(x.links for g in runs[at:end] for x, _ in g) < 2:
            kinds[at:end] = ["plain"] * (end - at)
        at = end
    first, last = kinds.index("content"), len(kinds) - 1 - kinds[::-1].index("content")
    while first and kinds[first - 1] == "plain":
        first -= 1
    while last + 1 < len(kinds) and kinds[last + 1] == "plain":
        last += 1
    return [x for g, kind in zip(runs[first : last + 1], kinds[first : last + 1]) if kind != "linked" for x, _ in g]


def mostly_linked(lines: list[Line]) -> bool:
    return 2 * sum(x.linked for x in lines) >= sum(len(x.text) - x.text.count(" ") for x in lines)


def main_text(html: str) -> str:
    """The main text of a page: its lines joined by a line feed; '' if it has none.

    Broken markup is read as far as it goes; a tag that the page's end cuts off is no text.
    """
    events = Events()
    # no tag ends after the last >, and the parser would look for one from each < anew
    last = html.rfind(">") + 1
    cut = CUT_TAG.search(html, last)
    events.feed(html[: cut.start()] if cut else html)
    events.close()
    return "\n".join([x.text for x in chosen(events.lines)])


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of text).

    Null and empty html give ''. Whole pages are read; white space in a line becomes one blank; nothing is
    capped. Repeated rows give equal results; further columns are ignored; an empty table stays empty.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = ", ".join(f"{c} {p.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pages in pieces(batch, "html"):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([main_text(h) for h in pages], pa.string())], names=["page_id", "url", "text"])

    out = p.mapInArrow(run, f"{kinds}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
