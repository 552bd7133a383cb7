"""Visible paragraph text of HTML pages, as an Arrow-batched function."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that are Python strings at once.
BATCH = 64
#: Elements whose whole content is dropped.
HIDDEN = {"script", "style", "nav", "footer", "header", "aside", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Paragraphs(HTMLParser):
    """Collects the strings inside each p. A p isn't closed by another p: text of an inner one is in the outer too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []
        self.found: list[list[str]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        own = None
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "p" and not self.hidden:
            own = []
            self.found.append(own)
        self.stack.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                self.hidden -= t in HIDDEN
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := data.strip()):
            for _, own in self.stack:
                if own is not None:
                    own.append(text)


def paragraphs(html: str | None) -> list[str]:
    """The stripped strings of each paragraph, joined without anything between; empty paragraphs are left out."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    return [text for own in parser.found if (text := "".join(own))]


def html_batch(pages: pa.Array) -> pa.Array:
    """paragraphs() of each page; only BATCH pages at once are Python's."""
    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind)] + [pa.array([paragraphs(p) for p in pages.slice(at, BATCH).to_pylist()], kind) for at in range(0, len(pages), BATCH)])


def html_paragraphs(c: Column) -> Column:
    return F.arrow_udf(lambda pages: html_batch(pages), "array<string>")(c)


def page_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with paragraphs and text, its paragraphs one to a line."""
    return pages.withColumn("paragraphs", html_paragraphs(F.col(html_col))).withColumn("text", F.array_join("paragraphs", "\n"))
