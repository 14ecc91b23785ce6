"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines (blocks); each line has
its text, its tags and its link text. The ratios of text to tags are smoothed by a Gaussian and
clustered by a threshold; the regions of the page whose lines lie above it are content, with all
that is in them. Lines in elements that never hold an article (menus, forms, scripts, ...) take
no part. Where the page marks an article, the clustering is between the articles it marks, and of one alone all lines stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Elements whose text is no part of an article.
NEVER = frozenset(
    "head script style noscript template iframe object svg canvas audio video nav header footer aside form "
    "button select option textarea input dialog menu".split()
)
#: Those of them that stand within a line and do not end it.
INLINE = frozenset("script style noscript template iframe object svg canvas audio video button select option textarea input".split())
#: Words of class, id or role that mark reader comments; on an article only as whole names ('comment', not 'has-comments').
COMMENTS = frozenset("comment comments disqus reply replies".split())
#: Words that mark menus, headers, footers, sidebars, notices, adverts and forms beside an article; an article inside such
#: an element counts none the less, and so does an element that holds most of the text. On an element that is no
#: container they count only as whole names ('notice', not 'notice-board').
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "complementary contentinfo".split()
)
#: Words that leave a mark what it is ('comment-list', 'ad-slot'). Inside an article a name with any other word
#: ('comments-policy', 'menu-item') is a doubt that the ratio decides, and so is any mark on an element made for content.
PLAIN = frozenset(
    "area body bottom box btn button block close container content count counter footer form group header holder icon image img inline inner "
    "left link links list main outer panel placeholder reader right row section side slot small space tag target text thread title top unit user users "
    "widget wrap wrapper zone s".split()
)
QUOTED = frozenset("blockquote pre figcaption caption".split())
#: Elements in which a mark may be part of a name; headings are never excluded by a mark.
CONTAINERS = frozenset("div section ul ol dl table td details figure center fieldset header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names with one of these words tell a state of the element ('with-sidebar'), not what it is.
STATES = frozenset("has with no without open closed enabled disabled".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr "
    "html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ARTICLE = frozenset(("article", "main"))
#: Parts of a page that are content or not; a section belongs to what is around it.
REGIONS = frozenset("article main div td body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIGMA = 1.0
_WORD = re.compile(r"[a-z]+")


def _ends_line(tag: str, out: str) -> bool:
    """Whether an element that is excluded so begins and ends a line: not a script or a hidden word within one."""
    return out in ("beside", "doubt") or (out == "always" and tag not in INLINE and (tag in BLOCKS or tag in NEVER))


#: What a start tag ends if it is open, and what that is looked for in at most: their end tags may be left out.
CELLS, ROWS, PARTS = ("td", "th"), ("tr", "td", "th"), ("thead", "tbody", "tfoot", "tr", "td", "th", "caption")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "td": (CELLS, ("table", "tr")),
    "th": (CELLS, ("table", "tr")),
    "tr": (ROWS, ("table",)),
    "thead": (PARTS, ("table",)),
    "tbody": (PARTS, ("table",)),
    "tfoot": (PARTS, ("table",)),
}


class Lines(HTMLParser):
    """Lines of a page: [text parts, tags, link code points, region, number of the outermost article, marked element around it]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        # open elements that matter: name, how it is excluded ('', 'always' or 'beside'), region, marked element around it
        self.stack: list[tuple[str, str, int, int]] = []
        #: Where in the stack the open elements of a name are, so that no tag walks over it.
        self.open: dict[str, list[int]] = defaultdict(list)
        #: ``beside`` is the innermost open element marked as beside the article, 0 for none; an article suspends those around it.
        self.always = self.in_article = self.articles = self.links = self.regions = self.beside = 0
        #: The marked element around each marked element, and those of them that are doubtful.
        self.marks, self.doubts = [0], set()
        self.line = None
        #: The region around each region, 0 for none, and whether it is a cell or the body.
        self.around, self.cell, self.body = [0], [False], [False]

    def _break(self) -> None:
        self.line = None

    def _region(self) -> int:
        at = max((self.open[tag][-1] for tag in REGIONS if self.open[tag]), default=-1)
        return self.stack[at][2] if at >= 0 else 0

    def _current(self) -> list:
        if self.line is None:
            self.line = [[], 0, 0, self._region(), self.articles if self.in_article else 0, self.beside]
            self.lines.append(self.line)
        return self.line

    def _exclusion(self, tag, attrs) -> str:
        if tag in NEVER:
            return "always"
        words: set[str] = set()
        names: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "always"
            if value and name in ("class", "id", "role"):
                for part in value.lower().split():
                    found = _WORD.findall(part)
                    if STATES.isdisjoint(found):
                        words.update(found)
                        names.add(part)
        if tag in ("html", "body", "main"):
            return ""
        if not COMMENTS.isdisjoint(names if tag in ARTICLE else words):
            return "always" if tag in ARTICLE or self._plain(names, COMMENTS) else "doubt" if tag in BLOCKS else ""
        if tag in ARTICLE or tag in HEADINGS or MARKS.isdisjoint(words if tag in CONTAINERS else names):
            return ""
        if self.in_article and tag in BLOCKS and (tag in QUOTED or not self._plain(names, MARKS)):
            return "doubt"
        return "beside"

    def _plain(self, names, marks) -> bool:
        """Whether one of the names consists of a mark and of words that leave it what it is."""
        for name in names:
            found = set(_WORD.findall(name))
            if not marks.isdisjoint(found) and found <= marks | PLAIN:
                return True
        return False

    def _close(self, i: int) -> None:
        """End the open elements from number ``i`` on."""
        for name, out, _, beside in reversed(self.stack[i:]):
            self.open[name].pop()
            self.always -= out == "always"
            self.beside = beside
            self.in_article -= name in ARTICLE
            if _ends_line(name, out):
                self._break()
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._break()
            if tag != "br" and self.stack and self.stack[-1][0] == "p":
                self._close(len(self.stack) - 1)  # it needs no end tag
        if tag in ENDS:
            ended, within = ENDS[tag]
            edge = max((self.open[x][-1] for x in within if self.open[x]), default=-1)
            first = min((self.open[x][-1] for x in ended if self.open[x] and self.open[x][-1] > edge), default=-1)
            if first >= 0:
                self._close(first)
        if tag in VOID:
            if tag not in BLOCKS and self.line is not None:
                self.line[1] += 1
            return
        out = self._exclusion(tag, attrs)
        if _ends_line(tag, out):
            self._break()
        if out or tag in REGIONS or tag in BLOCKS and tag not in ("p", "li", "dt", "dd", "html"):
            if tag in REGIONS:
                self.around.append(self._region())
                self.cell.append(tag == "td")
                self.body.append(tag == "body")
                self.regions += 1
            self.open[tag].append(len(self.stack))
            self.stack.append((tag, out, self.regions if tag in REGIONS else 0, self.beside))
            self.always += out == "always"
            if tag in ARTICLE:
                self.beside = 0
            elif out in ("beside", "doubt"):
                self.marks.append(self.beside)
                self.beside = len(self.marks) - 1
                if out == "doubt":
                    self.doubts.add(self.beside)
            self.articles += tag in ARTICLE and not self.in_article
            self.in_article += tag in ARTICLE
        self.links += tag == "a"
        if tag not in BLOCKS and self.line is not None:
            self.line[1] += 1

    def handle_startendtag(self, tag, attrs):
        # a slash ends drawings and formulas and what is in them; on any other element it means nothing in HTML
        if tag not in ("svg", "math") and not self.open["svg"] and not self.open["math"]:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in NEVER and tag not in INLINE:
            self._break()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag]:
            self._close(self.open[tag][-1])

    def handle_data(self, data):
        if self.always:
            return
        line = self._current()
        line[0].append(data)
        if self.links:
            line[2] += len(data)


def _smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel renormalised at both ends."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        part = kernel[low - i + radius : high - i + radius]
        out.append(sum(k * v for k, v in zip(part, values[low:high], strict=True)) / sum(part))
    return out


def _ratio(text: str, tags: int, linked: int) -> float:
    """Code points outside links for each tag."""
    return max(0, len(text) - linked) / (1 + tags)


def _unmarked(lines: list[tuple], around: list[int], doubts: set[int]) -> list[tuple]:
    """Lines in no marked element but such as hold over half of the text outside links; all if none is left.

    A doubtful mark counts if tags and links thin the text of its element to a ratio below half of its length.
    """
    held, ratio, length = ([0.0] * len(around) for _ in range(3))
    for text, tags, linked, _, _, mark in lines:
        held[mark] += max(0, len(text) - linked)
        ratio[mark] += _ratio(text, tags, linked)
        length[mark] += len(text)
    total = sum(held)
    for m in range(len(around) - 1, 0, -1):
        if around[m]:
            for of in (held, ratio, length):
                of[around[m]] += of[m]
    out = [False] * len(around)
    for m in range(1, len(around)):
        out[m] = out[around[m]] or (2 * ratio[m] < length[m] if m in doubts else 2 * held[m] <= total)
    return [x for x in lines if not out[x[5]]] or lines


def _inside(parser: Lines, content: set[int], text: set[int]) -> list[bool]:
    """For each region, whether it is kept when those of ``content`` are, and what is around all of ``text``."""
    around = parser.around
    held = [0] * len(around)  # regions of text inside each region, itself included
    for r in range(len(around) - 1, 0, -1):
        held[r] += r in text
        held[around[r]] += held[r]
    whole = max((r for r in range(1, len(around)) if held[r] == len(text)), default=0)
    kept = [0 in content] + [False] * (len(around) - 1)
    for r in range(1, len(around)):
        outer = around[r]
        top = not outer or parser.body[outer]  # of the body, and of what has none, only cells are part
        kept[r] = r in content or (r == whole and not parser.body[r]) or (kept[outer] and (not top or parser.cell[r]))
    return kept


def _threshold(smooth: list[float]) -> float:
    """The standard deviation of all smoothed ratios."""
    mean = sum(smooth) / len(smooth)
    return math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by a newline; '' for null, empty or text-less pages.

    White space inside a block becomes one space. A part of the page is content if one of its lines has a ratio and a smoothed
    ratio of at least the threshold (the part with the highest smoothed ratio always is), and all that is inside it is kept, short lines,
    tables and nested parts included. Where the page marks articles (article, main), the outermost of these are the parts;
    else regions (div, cell, body) are, if their ratios sum to at least the threshold of all regions' sums (so not a footer, though its line be as
    long as the article's), and so is the smallest region around all of them; but of the body, as it is around
    everything, only its own lines and cells. Unclosed and stray tags, cut pages and any nesting depth are fine.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = []
    for parts, tags, linked, region, article, mark in parser.lines:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, tags, linked, region, article, mark))
    marked = [x for x in lines if x[4]]
    lines = _unmarked(marked or lines, parser.marks, parser.doubts)
    if not lines:
        return ""
    ratios = [_ratio(*x[:3]) for x in lines]
    smooth = _smooth(ratios)
    threshold = _threshold(smooth)
    best = max(range(len(lines)), key=smooth.__getitem__)
    part = 4 if marked else 3
    content = {lines[best][part]} | {x[part] for x, s, r in zip(lines, smooth, ratios, strict=True) if s >= threshold and r >= threshold and s > 0}
    text = {x[part] for x, s, r in zip(lines, smooth, ratios, strict=True) if s >= threshold and r >= threshold and r > 0}  # not only next to text
    if marked:
        return "\n".join(x[0] for x in lines if x[4] in (text or content))
    mass = dict.fromkeys((x[3] for x in lines), 0.0)
    for x, r in zip(lines, ratios, strict=True):
        mass[x[3]] += r
    least = _threshold(list(mass.values()))
    large = {region for region, m in mass.items() if m >= least}
    content, text = content & large or large, text & large
    kept = _inside(parser, content, text or content)
    return "\n".join(x[0] for x in lines if kept[x[3]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``; other columns are ignored.

    Null html is an empty page with the text ''. Repeated rows are each extracted; null ids and urls stay null.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
