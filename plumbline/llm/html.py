"""Main text of a page from parser events and the text-to-tag ratio.

The standard library's parser is fed in slices; its events become lines, one for each block element's own run of text,
with the number of tags and of linked characters in it and the place in the tree. Elements that never hold main text
(menus, headers, footers, asides, forms, scripts, styles, and those whose class, id or role says advert, notice,
sidebar or comment) mark their lines as outside. Only when it is known where the text lies is such an element believed: a
form, or an element named after a sidebar, that holds more than half of the text of upper lines is the page's wrapper,
and so is a header or menu with the article in it; readers' comments, adverts and notices never are.

The ratio of text to tags of every line is smoothed by a Gaussian over its neighbours, and lines split into two
clusters at a threshold: the mean of the lower and of the upper lines' means, found by iteration. The content region is
then found by walking down from the page: into the block that holds all text of upper lines, or into the article or
main element that holds more than half of it and has no other article beside it with a fifth of its text. The region is kept whole, short lines included, with the headings right
before it, save for the lines that are outside. An outside element within a line is cut out and leaves the line whole.

Blocks are joined by line breaks; white space inside a block becomes one space; character references are decoded.

Cases: a null or empty page has the empty text; a page cut off in the middle counts as closed there; unknown end tags
are ignored; a page without any upper line in a region keeps all lines that are not outside; rows are independent, so
repeated rows and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import python_ready

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that part words but not blocks.
SPACERS = frozenset("br td th img".split())
#: Elements whose text is never shown or is no prose.
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input map math menu nav noscript object"
    " option script select style svg template textarea title video".split()
)
#: Elements of these that may be the page's wrapper instead, if they hold most of its text; the others hold none in any case.
SOFT = frozenset("aside form header nav".split())
#: Words of a class, an id or a role that name what is not main text, on any element.
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment commentarea commentbox commentform commentlist"
    " comments commentsection commentthread consent contentinfo cookie"
    " cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination promo promoted share sharing"
    " sidebar signup sponsor sponsored subscribe toolbar widget widgets".split()
)
#: The same where the element is one that only groups others: as names of a paragraph they may tell what it is about.
GROUP_NAMES = OUTSIDE_NAMES | frozenset(
    "aside banner complementary login notice notices popup promotion recommended related replies reply respond search social".split()
)
GROUPS = frozenset("div section ul ol dl table aside nav header footer form figure details fieldset center".split())
#: Names that a wrapper of the whole page never has: readers' comments and adverts.
NEVER_WRAPPERS = frozenset(
    "ad ads adsense advert adverts advertisement advertising comment commentarea commentbox commentform commentlist comments commentsection"
    " commentthread cookie cookies disqus gdpr promo promoted replies reply respond sponsor sponsored".split()
)
#: Names that often tell how a whole page is laid out.
LAYOUT_NAMES = frozenset("sidebar sticky widget widgets".split())
#: Words that may stand beside such a name in a compound like ``main-nav`` or ``share-buttons``.
BESIDE = frozenset(
    "area article bar block bottom box button buttons container content fixed form global group header icon icons info inner item items law left"
    " link links list main mobile outer page panel post posts primary reader readers right row secondary section site slot small sticky text thread"
    " title top unit user users wrap wrapper".split()
)
#: Region elements are only outside if a name stands alone in their class or id.
REGIONS = frozenset("article main body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of which one may be the content region.
CONTAINERS = frozenset("article body center div main section".split())
#: What may stand in a head; the start of anything else, or text, closes it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An open element is closed by the start of one of these.
#: The start of the main text closes menus that were left open.
MAIN_CLOSES = frozenset(["nav"])
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_NAME = re.compile(r"[a-z0-9]+")
SLICE = 1 << 16


#: How an element lies outside: not at all, unless it wraps the page, unless it does so around an article, in any case.
INSIDE, LAYOUT, MENU, HARD = range(4)


def named_outside(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element's attributes say that it holds no main text.

    Headings are never named so: their ids and classes tell what they are about; neither is a section by its id alone,
    unless it is the readers' comments or adverts.
    """
    kind = INSIDE
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return HARD if tag not in ("html", "body") else INSIDE
        if key in ("class", "id", "role") and tag not in ("html", "body") and tag not in HEADINGS and not (key == "id" and tag == "p"):
            known = GROUP_NAMES if tag in GROUPS else OUTSIDE_NAMES
            for name in value.split():
                parts = [name] if tag in REGIONS else _NAME.findall(name)
                named = [p for p in parts if p in known]
                if not named or not all(p in known or p in BESIDE for p in parts):
                    continue
                if any(p in NEVER_WRAPPERS for p in named):
                    return HARD
                if key != "id" or tag != "section":
                    kind = max(kind, LAYOUT if all(p in LAYOUT_NAMES for p in named) else MENU)
    return kind


class Lines(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int, int]] = []  # tag, outside element, cut out of its line, container, container of its lines
        self.lines: list[tuple[str, int, int, int, bool, int]] = []  # text, tags, linked, outside element, heading, container
        self.outside: list[list] = [[0, INSIDE, False]]  # of each outside element the one around it, its kind, whether an article is or stands in it
        self.parents = [0]  # of each container; 0 is the page
        self.articles: set[int] = set()
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.heads = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, outside, _, _, box = self.open[-1] if self.open else ("", 0, False, 0, 0)
            self.lines.append((text, self.tags, self.linked, outside, self.heads > 0, box))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, depth: int) -> None:
        for x in self.open[depth:]:
            self.links -= x[0] == "a"
            self.heads -= x[0] in HEADINGS
        del self.open[depth:]

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.end_line()
            self.pop_to(len(self.open) - 1)

    def end_menus(self) -> None:
        for depth, element in enumerate(self.open):
            if element[0] in MAIN_CLOSES:
                self.end_line()
                self.pop_to(depth)
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        kind = named_outside(tag, attrs)
        if tag in OUTSIDE:
            kind = max(kind, LAYOUT if tag == "form" else MENU if tag in SOFT else HARD)
        if tag in ("article", "main"):
            self.end_menus()
        if tag in BLOCKS:
            self.end_line()
            if self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self.pop_to(len(self.open) - 1)
        elif tag in SPACERS:
            self.parts.append(" ")
        _, outside, cut, box, line_box = self.open[-1] if self.open else ("", 0, False, 0, 0)
        self.tags += not cut
        if tag in VOID:
            return
        if tag in BLOCKS:
            # Text right in a container is a paragraph of the container around it.
            line_box = box
        if tag in CONTAINERS:
            self.parents.append(box)
            box = len(self.parents) - 1
            if tag in ("article", "main"):
                line_box = box
                self.articles.add(box)
        if kind:
            self.outside.append([outside, kind, False])
            outside = len(self.outside) - 1
        if tag in ("article", "main"):
            around = outside
            while around and not self.outside[around][2]:
                self.outside[around][2] = True
                around = self.outside[around][0]
        self.open.append((tag, outside, cut or (kind > INSIDE and tag not in BLOCKS), box, line_box))
        self.links += tag == "a"
        self.heads += tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not (self.open and self.open[-1][2])
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                if tag in BLOCKS:
                    self.end_line()
                self.pop_to(depth)
                break
        if tag in SPACERS:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if self.open and self.open[-1][2]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over three neighbours at each side; weights beyond the ends are left out."""
    reach = np.arange(-3, 4)
    weights = np.exp(-0.5 * (reach / sigma) ** 2)
    pad = len(reach) // 2
    total = np.convolve(np.pad(values, pad), weights, "valid")
    return total / np.convolve(np.pad(np.ones(len(values)), pad), weights, "valid")


def threshold(values: np.ndarray) -> float:
    """Between two clusters: the middle of the means of the values below and above it."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


#: An article is the content region alone if no article beside it has this share of its text.
ALONE = 0.2


def content_region(parents: list[int], articles: set[int], boxes: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which lines are in the content region; parents come before what they hold.

    ``sizes`` is the text of upper lines, ``whole`` that of all lines that are not outside.
    """
    held, text = (np.bincount(boxes, x, len(parents)).tolist() for x in (sizes, whole))
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
        text[parents[k]] += text[k]
    # Of each container the two greatest articles right in it.
    most, second = [0.0] * len(parents), [0.0] * len(parents)
    for k in articles:
        around = parents[k]
        if text[k] > most[around]:
            most[around], second[around] = text[k], most[around]
        else:
            second[around] = max(second[around], text[k])
    region = 0
    for k in range(1, len(parents)):
        around = parents[k]
        is_region = 2 * held[k] > held[region] and second[around] < ALONE * text[k] if k in articles else held[k] == held[region]
        if around == region and is_region:
            region = k
    inside = np.zeros(len(parents), bool)
    inside[region] = True
    for k in range(region + 1, len(parents)):
        inside[k] = inside[parents[k]]
    return inside[boxes]


def outside_lines(nodes: list[list], owners: np.ndarray, upper_sizes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which lines are outside: below an outside element that does not wrap the page.

    An element that holds more than half of the text of upper lines, as far as such text is not outside in any case, is a
    wrapper: a form around the page, a body named after its sidebar, a menu that swallowed an article.
    """
    hard = [kind == HARD for _, kind, _ in nodes]
    for k in range(1, len(nodes)):
        hard[k] = hard[k] or hard[nodes[k][0]]
    held = np.bincount(owners, upper_sizes(np.array(hard)[owners]), len(nodes)).tolist()
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k][0]] += held[k]
    out = [False] * len(nodes)
    for k, (around, kind, has_article) in enumerate(nodes[1:], 1):
        wraps = kind < HARD and (kind == LAYOUT or has_article) and 2 * held[k] > held[0]
        out[k] = out[around] or not wraps
    return np.array(out)[owners]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    parser = Lines()
    for at in range(0, len(page), SLICE):
        parser.feed(page[at : at + SLICE])
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    sizes = np.array([len(x[0]) for x in lines], float)
    plain = np.array([max(0, len(x[0]) - x[2]) for x in lines], float)
    tags = np.maximum(1, [x[1] for x in lines])

    def upper_lines(outside: np.ndarray) -> np.ndarray:
        ratio = smoothed(np.where(outside, 0.0, plain / tags))
        return (ratio >= threshold(ratio)) & ~outside

    outside = outside_lines(parser.outside, np.array([x[3] for x in lines]), lambda hard: np.where(upper_lines(hard), plain, 0.0))
    upper = upper_lines(outside)
    chosen = ~outside
    if upper.any():
        within = content_region(parser.parents, parser.articles, np.array([x[5] for x in lines]), np.where(upper, sizes, 0.0), np.where(outside, 0.0, sizes))
        first = int(np.argmax(within))
        while first > 0 and lines[first - 1][4] and not outside[first - 1]:
            first -= 1
            within[first] = True
        chosen &= within
    return "\n".join(x[0] for x, c in zip(lines, chosen, strict=True) if c)


def _extract(html_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html_at).to_pylist()]
            kept = [batch.column(i) for i in range(html_at)]
            columns = [*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:html_at], "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` and text, n_chars of every page."""
    python_ready(pages.sparkSession)
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(_extract(len(keep)), rows.drop("_html").schema.add("text", "string").add("n_chars", "long"))
