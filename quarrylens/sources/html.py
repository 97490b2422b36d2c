"""Filings in HTML to elements: headers, paragraphs and tables in reading order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADERS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADERS | {"p", "div", "li", "tr", "section", "article", "title", "br"}
_SILENT = {"script", "style", "head", "noscript"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool, str]] = []
        self._text: list[str] = []
        self._tables = self._silent = self._bold = self._plain = 0
        self._header = False
        self._in_bold = 0  # open bold tags, whatever stands inside them

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split()) if not self._tables else ""
        if text and not self._tables:
            self.out.append(("text", self._header or (self._bold > 0 and not self._plain), text))
            self._text.clear()
        self._bold = self._plain = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _SILENT:
            self._silent += 1
        elif tag == "table":
            self._flush()
            self._tables += 1
        elif self._tables:
            if tag == "tr":
                self._text.append("\n")
            elif tag in ("td", "th"):
                self._text.append(" | ")
        elif tag in _BLOCKS:
            self._flush()
            self._header = tag in _HEADERS
        elif tag in ("b", "strong"):
            self._in_bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "table" and self._tables:
            self._tables -= 1
            if not self._tables:
                rows = [" ".join(r.split()).strip("| ") for r in "".join(self._text).split("\n")]
                self._text.clear()
                if any(rows):
                    self.out.append(("table", False, "\n".join(r for r in rows if r)))
        elif tag in _BLOCKS and not self._tables:
            self._flush()
            self._header, self._in_bold = False, 0  # a bold tag that was left open ends with its block
        elif tag in ("b", "strong"):
            self._in_bold = max(0, self._in_bold - 1)

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if data.strip():
            if self._in_bold:
                self._bold += 1
            else:
                self._plain += 1
        self._text.append(data)


def blocks(html: str | None) -> list[tuple[str, bool, str]]:
    """(kind, is_header, text) of each block; a paragraph that is bold throughout counts as a header. Broken markup is read as far
    as it goes; null gives none."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p._tables = 0
    p._flush()
    return p.out


def html_elements(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, seq, kind, is_header, text. Row by row, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(str(i), n, *b) for i, h in zip(f["doc_id"], f["html"]) for n, b in enumerate(blocks(h))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "kind", "is_header", "text"])

    src = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.col(html_col).alias("html")).filter("doc_id IS NOT NULL")
    return src.mapInPandas(run, "doc_id string, seq int, kind string, is_header boolean, text string")
