"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams events of a page. They become lines (blocks of text), each with
the number of tags that came with it and the container it stands in. Lines of parts that are never
the article (scripts, navigation, forms, adverts, comments and so on) are set aside. The text-to-tag
ratios of the other lines are smoothed with a Gaussian kernel and split into two clusters; the
high cluster marks the content. The article, or else the smallest container of all marked text, is the content
region, and all its lines are kept, so that short paragraphs between long ones are not lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea label fieldset dialog menu iframe object svg "
    "canvas audio video map datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend option".split()
)
CLOSES_P = BLOCKS - frozenset("html body tbody td tfoot th thead tr caption legend option".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "option": "option", "tr": "tr", "td": "td", "th": "th"}
#: Words in class, id or role that name a part which is not the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar aside comment comments disqus reply replies respond menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "related recommended share sharing social newsletter subscribe signup login popup modal overlay toolbar pagination pager widget "
    "complementary contentinfo search skip".split()
)
ARTICLE = frozenset(("article", "main"))

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_part(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role") and any(w.lower() in PARTS for w in _WORDS.findall(value)):
            return True
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return True
    return False


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    path: tuple[int, ...]  # containers around the line, outermost first


@dataclass
class _Open:
    tag: str
    aside: bool  # what is inside is set aside
    container: int | None = None
    heading_only: bool = False


class PageLines(HTMLParser):
    """Collects the lines of one page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers: list[str] = []
        self._stack: list[_Open] = []
        self._parts: list[str] = []
        self._tags = self._linked = 0

    @property
    def _aside(self) -> bool:
        return bool(self._stack) and self._stack[-1].aside

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            path = tuple(o.container for o in self._stack if o.container is not None)
            self.lines.append(Line(text, self._tags, self._linked, path))
            self._tags = self._linked = 0
        self._parts = []

    def _pop_to(self, tag: str, barrier: frozenset[str] = frozenset()) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag == tag:
                del self._stack[i:]
                return
            if self._stack[i].tag in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._pop_to("p", CONTAINERS)
        if tag in SAME_CLOSES:
            self._pop_to(tag, frozenset(("ul", "ol", "dl", "table", "select")))
            self._pop_to(SAME_CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        inside = any(o.tag in ARTICLE for o in self._stack)
        part = _names_part(attrs) and tag not in ("html", "body", *ARTICLE)
        outer = self._stack[-1] if self._stack else _Open("", False)
        if tag in ARTICLE and not any(o.aside and o.tag in ("nav", "aside", "footer", "template") or (o.aside and inside) for o in self._stack):
            aside = False  # an advert that was never closed does not swallow the article
        else:
            aside = outer.aside or tag in NEVER or part or (tag == "header" and not inside)
        heading_only = outer.heading_only or (tag == "header" and inside)
        if heading_only and not aside and tag in HEADINGS:
            heading_only = False
        container = None
        if tag in CONTAINERS:
            container = len(self.containers)
            self.containers.append(tag)
        self._stack.append(_Open(tag, aside, container, heading_only))

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        if tag not in VOID:
            self._pop_to(tag, frozenset(("article", "main")) if tag not in ("body", "html", "article", "main") else frozenset())

    def handle_data(self, data: str) -> None:
        if self._aside or (self._stack and self._stack[-1].heading_only):
            return
        self._parts.append(data)
        if any(o.tag == "a" for o in self._stack):
            self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed_ratios(lines: list[Line], sigma: float = 1.0) -> np.ndarray:
    """Text-to-tag ratio of every line, smoothed over its neighbours; linked text does not count."""
    raw = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(raw)), kernel)[reach : reach + len(raw)]
    return np.convolve(raw, kernel)[reach : reach + len(raw)] / weight


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of values (two means, from the extremes on)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        border = (low + high) / 2
        upper, lower = values[values >= border], values[values < border]
        moved = (float(lower.mean()) if len(lower) else low, float(upper.mean()) if len(upper) else high)
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    page = PageLines()
    for i in range(0, len(html), PIECE):
        page.feed(html[i : i + PIECE])
    page.close()
    lines = page.lines
    if not lines:
        return ""
    ratios = smoothed_ratios(lines, sigma)
    marked = ratios >= threshold(ratios)
    # text marked as content, by container; an article or main part stands for all it holds
    weight: dict[int, int] = {}
    for line, hit in zip(lines, marked.tolist()):
        if hit:
            for c in line.path:
                weight[c] = weight.get(c, 0) + len(line.text)
    named = [c for c in weight if page.containers[c] in ARTICLE]
    if named:
        top = [c for c in named if not any(c in x.path and set(x.path[: x.path.index(c)]) & set(named) for x in lines)]
        region = set(top)
    else:
        # the innermost container with all marked text, so that no sibling part of the article is lost
        total = sum(len(x.text) for x, hit in zip(lines, marked.tolist()) if hit)
        region = {max((c for c in weight if weight[c] == total), default=-1)}
    if region == {-1}:
        return "\n".join(x.text for x in lines)
    return "\n".join(x.text for x in lines if region & set(x.path))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(h) if (h := x.as_py()) else "" for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty pages have empty text; null and repeated ids and urls are passed on; an empty table
    gives no rows. Extra columns are not read. Pages are independent, so nothing is shuffled.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
