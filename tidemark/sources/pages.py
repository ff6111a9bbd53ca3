"""Records out of captured HTML pages, without a network: cards, labels with values, outbound links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style"}


class PageParser(HTMLParser):
    """Collects a page's title, links, headings, list items and paragraphs; malformed markup is taken as it comes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.items, self.paragraphs = "", [], [], []
        self._open: list[str] = []
        self._text: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self._open.append(tag)
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in ("title", "li", "p"):
            self._text[tag] = []

    def handle_endtag(self, tag):
        if tag in self._open:
            while self._open and self._open.pop() != tag:
                pass
        if tag in self._text:
            text = " ".join("".join(self._text.pop(tag)).split())
            if tag == "title":
                self.title = text
            elif text:
                (self.items if tag == "li" else self.paragraphs).append(text)

    def handle_data(self, data):
        if not SKIP & set(self._open[-2:]):
            for tag in self._text:
                self._text[tag].append(data)


def parse(html: str | None) -> PageParser:
    p = PageParser()
    p.feed(html or "")
    p.close()
    return p


def next_page(links: list[str], base: str) -> str | None:
    """The first link with the next page number of the same list, made absolute; None if there is none."""
    here = urlsplit(base)
    page = next((int(v) for k, _, v in (q.partition("=") for q in here.query.split("&")) if k == "page" and v.isdigit()), 1)
    for href in links:
        to = urlsplit(urljoin(base, href))
        if to.netloc == here.netloc and to.path == here.path and f"page={page + 1}" in to.query.split("&"):
            return to.geturl()
    return None


def cards(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_external, items, n_paragraphs, text_chars, next_url: a row per page, by Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(b.page_id, b.url, b.html, strict=True):
                p, host = parse(html), urlsplit(url or "").netloc
                absolute = [urljoin(url or "", x) for x in p.links]
                external = sum(urlsplit(x).netloc not in ("", host) and urlsplit(x).path.strip("/") != "" for x in absolute)
                rows.append((page_id, p.title, len(p.links), external, "|".join(p.items), len(p.paragraphs), sum(map(len, p.paragraphs)), next_page(p.links, url or "")))
            yield pd.DataFrame(rows, columns=["page_id", "title", "n_links", "n_external", "items", "n_paragraphs", "text_chars", "next_url"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, n_links long, n_external long, items string, n_paragraphs long, text_chars long, next_url string")


def labels(pages: DataFrame) -> DataFrame:
    """page_id, label, value of list items 'label: value'."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(page_id, k.strip().lower(), v.strip()) for page_id, html in zip(b.page_id, b.html, strict=True) for k, colon, v in (i.partition(":") for i in parse(html).items) if colon and v.strip()]
            yield pd.DataFrame(rows, columns=["page_id", "label", "value"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, label string, value string")


def outbound(href: str | None, base: str, own: str) -> str | None:
    """A link to an advert elsewhere, absolute and without its fragment; None for the portal's own pages (domain own),
    other schemes and bare home pages."""
    raw = (href or "").strip()
    if not raw or raw == "#":
        return None
    try:
        to = urlsplit(urljoin(base, raw))
        host = (to.hostname or "").lower()
    except ValueError:
        return None
    if to.scheme not in ("http", "https") or len(host) < 3 or host == own or host.endswith(f".{own}"):
        return None
    if not to.path.strip("/") and not to.query:
        return None
    return f"{to.scheme}://{to.netloc}{to.path}{'?' + to.query if to.query else ''}"


def outbound_links(pages: DataFrame, own: str) -> DataFrame:
    """page_id, link of every outbound link of a page, in order and as often as it stands there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(page_id, link) for page_id, url, html in zip(b.page_id, b.url, b.html, strict=True) for href in parse(html).links if (link := outbound(href, url or "", own))]
            yield pd.DataFrame(rows, columns=["page_id", "link"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, link string")
