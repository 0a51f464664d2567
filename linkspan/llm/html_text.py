"""Main text of web pages from text-to-tag ratios over streamed parser events.

The standard library's parser streams start, end and text events; a page's "lines" are its blocks of
text. Each block gets the ratio of its text to its tags (link text counts for the tags), ratios are
smoothed with a Gaussian along the page, and blocks over a threshold (a share of the page's standard
deviation around its mean) form the content clusters, runs of such blocks. The clusters choose the
regions: if one article or main element holds all of them, it is the region; else each cluster's
region is the least element over it that holds several blocks, or the innermost article or main over
that. All blocks of the regions are kept, so that a short paragraph between long ones isn't lost;
all others go. What the task excludes by name never counts, whatever its ratio: blocks in navigation,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments (by element,
role, class or id). A form around most of the page's text is a wrapper, not a form to fill in.

Work is linear in the page, however deep or unclosed its elements: elements are numbered as they
open, an element's blocks are an interval of numbers, and open elements are found by their tag.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are tolerated;
character references are decoded; white space in a block becomes one space; blocks are joined by one
space in page order; nothing is capped; repeated rows give equal rows; other columns pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never main text.
SKIP = frozenset("aside button canvas dialog fieldset footer head header iframe input label menu nav noscript object option script search select style svg template textarea title".split())
SKIP_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
#: Words of a class or id that mark what isn't the article.
SKIP_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback"
    " foot footer form header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo"
    " promoted promotion related recommended reply replies responses rail share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription"
    " teaser toolbar topbar toc widget".split()
)
#: On the article element itself, only these count: its class often names the page's layout.
ARTICLE_SKIP_WORD = frozenset("ad ads advert comment comments promo recommended related reply sidebar sponsored teaser".split())
#: A new block of the left side closes an open one of the right side.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table".split())
#: Any other element ends an open head.
IN_HEAD = frozenset("base link meta noscript script style template title".split())


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in SKIP:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "role" and value in SKIP_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            marks = ARTICLE_SKIP_WORD if tag in ("article", "main") else SKIP_WORD
            if not marks.isdisjoint(re.split(r"[^a-z]+", value)):
                return True
    return False


class Events(HTMLParser):
    """Collects blocks and elements, numbered as they open; number 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, unwanted
        self.open: dict[str, list[int]] = {}  # tag -> places in the stack
        self.open_blocks: list[int] = []  # places of block elements
        self.parent, self.last = [0], [0]  # by number: the element around it, the last element in it
        self.semantic: set[int] = set()  # numbers of article and main elements
        self.skipping = 0
        self.in_link = 0
        self.text: list[str] = []
        self.tags = 1
        self.link_chars = 0
        #: text, tags, link characters, number of the element, number of the form around it (or 0)
        self.blocks: list[tuple[str, int, int, int, int]] = []

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                forms = self.open.get("form")
                self.blocks.append((text, self.tags, self.link_chars, self.stack[-1][1] if self.stack else 0, self.stack[forms[0]][1] if forms else 0))
        self.text, self.tags, self.link_chars = [], 1, 0

    def close(self) -> None:
        super().close()
        self.end_block()
        self.pop_to(0)
        self.last[0] = len(self.parent) - 1

    def push(self, tag: str, unwanted: bool) -> int:
        number, at = len(self.parent), len(self.stack)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.last.append(number)
        self.stack.append((tag, number, unwanted))
        self.open.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.open_blocks.append(at)
        self.skipping += unwanted
        return number

    def pop_to(self, at: int) -> None:
        newest = len(self.parent) - 1
        while len(self.stack) > at:
            tag, number, unwanted = self.stack.pop()
            self.last[number] = newest
            self.skipping -= unwanted
            self.open[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()

    def topmost(self, tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown declaration is a comment up to the next ">"
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.in_link = 1
        if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self.pop_to(len(self.stack) - 1)
        if tag in VOID:
            return
        unwanted = _unwanted(tag, attrs)
        if tag in BLOCK:
            self.end_block()
            if self.stack and self.stack[-1][0] == "p":
                self.pop_to(len(self.stack) - 1)
            same = self.topmost(CLOSES.get(tag, ()))
            if same > self.topmost(LISTS):
                self.pop_to(same)
        if tag in BLOCK or unwanted:
            number = self.push(tag, unwanted)
            if tag in ("article", "main") or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs:
                self.semantic.add(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIP and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        if tag in BLOCK:
            self.end_block()
        at = self.topmost((tag,))
        # A paragraph's end closes the innermost element only, an inline end none beyond a block.
        least = len(self.stack) - 1 if tag == "p" else 0 if tag in BLOCK or not self.open_blocks else self.open_blocks[-1]
        if at >= max(0, least):
            self.pop_to(at)

    def handle_data(self, data):
        if not self.skipping:
            self.text.append(data)
            if self.in_link:
                self.link_chars += len(data.strip())


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(values, kernel)[reach : reach + len(values)]
    return padded / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def without_forms(blocks: list, semantic: set[int], last: list[int]) -> list:
    """Blocks outside of forms; one that holds over half of the text, and all articles that have any,
    is no form to fill in but a wrapper of the page."""
    size: dict[int, int] = {}
    for text, _, _, _, form in blocks:
        size[form] = size.get(form, 0) + len(text)
    wrapper = next((f for f, n in size.items() if f and 2 * n > sum(size.values())), 0)
    if wrapper:
        own = [b[3] for b in blocks if b[4] != wrapper]
        if any(bisect_left(own, e) < bisect_right(own, last[e]) for e in semantic):
            wrapper = 0
    return [b for b in blocks if b[4] in (0, wrapper)]


def clusters(blocks: list, sigma: float, level: float) -> list[tuple[int, int]]:
    """First and last block of each run of blocks over the threshold."""
    ratio = np.array([max(0, len(b[0]) - b[2]) / b[1] for b in blocks], float)
    even = smooth(ratio, sigma)
    over = np.concatenate([[False], even >= even.mean() - level * even.std(), [False]])
    turns = np.flatnonzero(over[1:] != over[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2])]


def without_forms(blocks: list, semantic: set[int], last: list[int]) -> list:
    """Blocks outside of forms; one that holds over half of the text, and all articles that have any,
    is no form to fill in but a wrapper of the page."""
    size: dict[int, int] = {}
    for text, _, _, _, form in blocks:
        size[form] = size.get(form, 0) + len(text)
    wrapper = next((f for f, n in size.items() if f and 2 * n > sum(size.values())), 0)
    if wrapper:
        own = [b[3] for b in blocks if b[4] != wrapper]
        if any(bisect_left(own, e) < bisect_right(own, last[e]) for e in semantic):
            wrapper = 0
    return [b for b in blocks if b[4] in (0, wrapper)]


def clusters(blocks: list, sigma: float, level: float) -> list[tuple[int, int]]:
    """First and last block of each run of blocks over the threshold."""
    ratio = np.array([max(0, len(b[0]) - b[2]) / b[1] for b in blocks], float)
    even = smooth(ratio, sigma)
    over = np.concatenate([[False], even >= even.mean() - level * even.std(), [False]])
    turns = np.flatnonzero(over[1:] != over[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2])]


def extract(html: str | None, sigma: float = 1.0, level: float = 0.5) -> str:
    """Main text of one page. level: threshold below the smoothed mean, in standard deviations."""
    if not html:
        return ""
    events = Events()
    try:
        events.feed(html)
    except (AssertionError, ValueError):  # the parser gives up on some broken declarations
        events.rawdata = ""
    events.close()
    blocks, parent, last = without_forms(events.blocks, events.semantic, events.last), events.parent, events.last
    if not blocks:
        return ""
    # Blocks are not in the order of their elements' numbers (text may follow a nested element).
    numbers = sorted(b[3] for b in blocks)

    def over(places: range | list[int]) -> int:
        """Least element over blocks; elements are numbered so that a nested one has a greater number."""
        low, high = min(blocks[i][3] for i in places), max(blocks[i][3] for i in places)
        while not low <= high <= last[low]:
            low = parent[low]
        return low

    def article(element: int) -> int | None:
        while element and element not in events.semantic:
            element = parent[element]
        return element or None

    runs = clusters(blocks, sigma, level)
    whole = article(over([i for a, b in runs for i in range(a, b + 1)]))
    regions = [whole] if whole else []
    if not regions:
        for a, b in runs:
            if regions and regions[-1] <= blocks[a][3] and blocks[b][3] <= last[regions[-1]] and regions[-1] <= over(range(a, b + 1)):
                continue  # inside the region before
            element = over(range(a, b + 1))
            while element and bisect_right(numbers, last[element]) - bisect_left(numbers, element) < 2:
                element = parent[element]
            regions.append(article(element) or element)
    edge = np.zeros(len(parent) + 1, np.int64)
    for element in regions:
        edge[element] += 1
        edge[last[element] + 1] -= 1
    inside = np.cumsum(edge) > 0
    return " ".join(b[0] for b in blocks if inside[b[3]])


def _extract(columns: list[str]):
    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column("_ls_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the html) plus text and n_chars; one pass, no shuffle."""
    small_batches(pages.sparkSession)
    columns = [c for c in (keep if keep is not None else [c for c in pages.columns if c != html_col]) if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in columns] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*columns, F.col(html_col).alias("_ls_html")).mapInArrow(_extract(columns), schema)
