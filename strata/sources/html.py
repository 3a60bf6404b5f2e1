"""Visible text, headings, links and images of saved pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript", "template", "head"}
_LAYOUT = {"nav", "footer", "aside"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "figure", "figcaption", "caption"}
ARTICLE = "title string, heading string, text string, links array<string>, images array<struct<url:string,alt:string,caption:string,section:string,layout:boolean>>, noindex boolean"


class Page(HTMLParser):
    """Reads a page in one pass; unclosed elements end with what holds them."""

    def __init__(self, url: str | None):
        super().__init__(convert_charrefs=True)
        self.url, self.stack = url or "", []
        self.title, self.parts, self.links, self.images = [], [], [], []
        self.heading, self.section, self.noindex = "", "", False
        self._head: list[str] | None = None
        self._caption: list[str] | None = None

    def _in(self, names: set[str]) -> bool:
        return any(t in names for t in self.stack)

    def _url(self, given: str | None) -> str | None:
        try:
            return urljoin(self.url, given.strip()) if given else None
        except ValueError:
            return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta":
            self.noindex |= (a.get("name") or "").lower() == "robots" and "noindex" in (a.get("content") or "").lower()
            return
        if tag == "a" and (link := self._url(a.get("href"))):
            self.links.append(link)
        if tag == "img":
            found = a.get("data-src") or a.get("src") or widest(a.get("srcset"))
            if link := self._url(found):
                layout = self._in(_LAYOUT)
                self.images.append({"url": link, "alt": a.get("alt"), "caption": None, "section": self.section or None, "layout": layout})
        if tag in _BLOCK:
            self.parts.append("\n")
        if tag in {"h1", "h2", "h3"}:
            self._head = []
        if tag == "figcaption":
            self._caption = []
        if tag not in {"br", "img", "hr", "input", "link", "source", "wbr"}:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in {"h1", "h2", "h3"} and self._head is not None:
            self.section = " ".join("".join(self._head).split())
            self.heading = self.heading or self.section
            self._head = None
        if tag == "figcaption" and self._caption is not None:
            if self.images:
                self.images[-1]["caption"] = " ".join("".join(self._caption).split())
            self._caption = None
        if tag in _BLOCK:
            self.parts.append("\n")
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] == "title":
            self.title.append(data)
        elif not self._in(_HIDDEN) and not self._in(_LAYOUT):
            self.parts.append(data)
        for held in (self._head, self._caption):
            if held is not None:
                held.append(data)


def widest(srcset: str | None) -> str | None:
    """The candidate of a srcset with the largest descriptor."""
    best: tuple[float, str] | None = None
    for entry in (srcset or "").split(","):
        bits = entry.split()
        if bits:
            try:
                size = float(bits[1][:-1]) if len(bits) > 1 else 1.0
            except ValueError:
                size = 0.0
            best = max(best, (size, bits[0])) if best else (size, bits[0])
    return best[1] if best else None


def article(url: str | None, html: str | None) -> dict:
    page = Page(url)
    page.feed(html or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.parts).split("\n"))
    return {
        "title": " ".join("".join(page.title).split()), "heading": page.heading, "text": "\n".join(x for x in lines if x),
        "links": list(dict.fromkeys(page.links)), "images": page.images, "noindex": page.noindex,
    }


def extract(pages: DataFrame, item: str, url: str, html: str) -> DataFrame:
    """A row with title, heading, text, links and images for each page; a null page is an empty one."""
    kind = pages.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([article(u, h) for u, h in zip(b[url], b[html])], columns=["title", "heading", "text", "links", "images", "noindex"])
            out.insert(0, item, b[item].to_numpy())
            yield out

    return pages.select(item, url, html).mapInPandas(run, f"{item} {kind}, {ARTICLE}")


def noindexed(headers: F.Column) -> F.Column:
    """Whether a map of response headers asks not to be indexed."""
    wanted = F.map_filter(headers, lambda k, v: (F.lower(k) == "x-robots-tag") & F.lower(v).contains("noindex"))
    return F.coalesce(F.cardinality(wanted) > 0, F.lit(False))
