"""Main text of web pages: parser events to lines, text-to-tag ratio, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("head title script style noscript template iframe object svg math nav footer aside form button select option textarea "
                    "dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words in a class or id that mark what is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
                  "breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices comment comments reply replies respond disqus "
                  "related recommended share sharing social newsletter subscribe subscription signup popup modal overlay widget toolbar "
                  "pagination pager".split())
#: Words of a class that turn a mark in it into a trait of a wrapper: has-sidebar, content-sidebar-wrap.
TRAITS = frozenset("has with no without".split())
WRAPPED, WRAPPERS = frozenset("content main page site layout".split()), frozenset("wrap wrapper layout container".split())
ENDED_BY_BLOCK = frozenset("p li dt dd option tr td th".split())
SIGMA, FACTOR = 1.5, 0.4
#: An article with less than this part of the longest article's text is a teaser.
TEASER = 0.1


def marked(value: str) -> bool:
    """Whether a class or id marks a part as not the article. A name that speaks of a wrapper and what it holds does not."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        if not MARKS.isdisjoint(parts) and TRAITS.isdisjoint(parts) and not (parts[0] in WRAPPED and parts[-1] in WRAPPERS):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, characters of links, container) for each block of a page, without what stands outside the article.

    A part that a form, a role or a mark leaves out ends where the page's first ``main`` or ``article`` begins: then it was a
    wrapper, or lacked its end. ``trusted`` is the number of a part that is not left out.
    """

    def __init__(self, trusted: int = 0):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links_open = 0
        self.skipped, self.depth = "", 0  # the tag that began what is left out, and how many of it are open
        self.loose, self.parts, self.trusted = False, 0, trusted  # whether that was no tag of its own kind; how many parts so far
        self.containers: list[tuple[str, int]] = []
        self.count = 0
        self.articles: set[int] = set()

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.containers[-1][1] if self.containers else 0))
        self.text, self.tags, self.linked = [], 0, 0

    def _outside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in OUTSIDE or tag == "header" and not self.containers:
            return True
        if tag in ("body", "html", "main", "article") and not any(n == "class" and "comment" in (v or "") for n, v in attrs):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in ROLES:
                return True
            if name in ("class", "id") and marked(value or ""):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if self.skipped in ENDED_BY_BLOCK and tag not in INLINE:
                self.skipped = ""
            elif self.loose and tag in ("main", "article") and not self.count and not self._outside(tag, attrs) and not any(
                    n in ("class", "id") and marked(v or "") for n, v in attrs):
                self.skipped = ""
            else:
                self.depth += tag == self.skipped
                return
        if tag not in INLINE:
            self._end_line()
        if tag not in VOID and self._outside(tag, attrs):
            self.parts += 1
            if self.parts != self.trusted:
                self.skipped, self.depth, self.loose = tag, 1, tag == "form" or tag not in OUTSIDE
                return
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links_open += 1
        elif tag in ("article", "main"):
            self.count += 1
            self.containers.append((tag, self.count))
            if tag == "article" and sum(t == "article" for t, _ in self.containers) == 1:
                self.articles.add(self.count)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/" closes nothing in HTML

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped:
                self.depth -= 1
                if not self.depth:
                    self.skipped = ""
                return
            if self.skipped not in ENDED_BY_BLOCK or tag in INLINE:
                return
            self.skipped = ""
        if tag not in INLINE:
            self._end_line()
        elif tag == "a":
            self.links_open = max(0, self.links_open - 1)
        if self.containers and tag == self.containers[-1][0]:
            self.containers.pop()

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)
            if self.links_open:
                self.linked += len(data)


def content_lines(lines: list[tuple[str, int, int, int]], articles: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The lines of the content regions.

    The ratio of a line is its text outside links over its tags. Ratios are smoothed with a Gaussian, and lines above a
    part of the mean form clusters. An ``article`` or ``main`` that holds a clustered line is taken whole, but for those of
    ``articles`` with little text beside the longest one; without such an element the region reaches from the first to the last
    clustered line.
    """
    if not lines:
        return []
    ratio = np.array([max(0, len(t) - linked) / (1 + tags) for t, tags, linked, _ in lines])
    reach = int(3 * SIGMA)
    bell = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * SIGMA ** 2))
    smooth = np.convolve(ratio, bell)[reach:reach + len(lines)] / np.convolve(np.ones(len(lines)), bell)[reach:reach + len(lines)]
    dense = smooth >= FACTOR * smooth.mean()
    if any(place for *_, place in lines):
        kept = {place for (*_, place), d in zip(lines, dense) if d and place} or {place for *_, place in lines if place}
        said = {place: 0 for place in articles}
        for text, _, linked, place in lines:
            if place in said:
                said[place] += max(0, len(text) - linked)
        teasers = {place for place, n in said.items() if n < TEASER * max(said.values())}
        return [t for t, *_, place in lines if place in kept - teasers]
    at = np.flatnonzero(dense)
    return [t for t, *_ in lines[at[0]:at[-1] + 1]] if len(at) else []


def main_text(html: str) -> str:
    """The article's blocks, a line each. A tag that the page breaks off in is no text."""
    last = html.rfind("<")
    if last > html.rfind(">") and html[last + 1:last + 2].strip(" /!").isalpha():
        html = html[:last]
    parser = _read(html)
    if parser.skipped and parser.loose and not parser.lines:  # a part without an end took the whole page: it was a wrapper, or lacks its end
        parser = _read(html, parser.parts)
    return "\n".join(content_lines(parser.lines, parser.articles))


def _read(html: str, trusted: int = 0) -> Lines:
    parser = Lines(trusted)
    parser.feed(html)
    parser.close()
    parser._end_line()
    return parser


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text) of all pages; the text is empty for null or empty html and for pages without content.

    The whole html is parsed, also when it is malformed or very long. Rows are independent: repeated ones, null ids and
    other columns do no harm. An empty table gives an empty result.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(parse, "page_id bigint, url string, text string")
