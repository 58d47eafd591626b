"""Pages of HTML to text and tables, with an error channel."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "template", "head"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "tr", "table", "main", "header", "blockquote", "pre"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.skip = 0
        self.inside = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag == "table":
            self.inside += 1
            self.tables.append([])
        elif tag == "tr" and self.inside:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.inside:
            self.cell = []
        if tag in _BLOCK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table":
            self.inside = max(0, self.inside - 1)
        elif tag in ("td", "th") and self.cell is not None:
            if self.tables and not self.tables[-1]:
                self.tables[-1].append([])
            if self.tables:
                self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag in _BLOCK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif not self.inside:
            self.text.append(data)


def parse(page: str | None) -> tuple[str, str | None, str, list]:
    """(status, reason, text, tables): ok, or failed with a reason. Tables are not part of the text."""
    if page is None or not page.strip():
        return "failed", "empty", "", []
    p = _Page()
    try:
        p.feed(page)
        p.close()
    except Exception as e:  # a page that the parser cannot take is a row of the error channel
        return "failed", f"corrupted: {type(e).__name__}", "", []
    lines = (" ".join(x.split()) for x in "".join(p.text).split("\n"))
    body = "\n".join(x for x in lines if x)
    if not body and not p.tables:
        return "failed", "no_text", "", []
    return "ok", None, body, [t for t in p.tables if t]


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, status, reason, text, tables (rows of cells): exactly one of parsed and failed for each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *parse(h)) for k, h in zip(f[key], f[html], strict=True)], columns=[key, "status", "reason", "text", "tables"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, status string, reason string, text string, tables array<array<array<string>>>")
