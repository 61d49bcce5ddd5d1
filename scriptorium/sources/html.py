"""HTML pages as rows of blocks, tables, figures and references, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "figcaption", "caption", "td", "th"}
_SKIP = {"script", "style", "nav", "template", "noscript"}


class _Reader(HTMLParser):
    """Collects (tag, text) blocks, table rows and image sources in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.images: list[tuple[str, str]] = []
        self._tag, self._text, self._skip = "", [], 0

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        if self._tag and text:
            self.blocks.append((self._tag, text))
            if self._tag in ("td", "th") and self.tables and self.tables[-1]:
                self.tables[-1][-1].append(text)
        self._tag, self._text = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self._skip += 1
        elif tag in _BLOCKS:
            self._close()
            self._tag = tag
        elif tag == "table":
            self._close()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._close()
            self.tables[-1].append([])
        elif tag == "img":
            found = dict(attrs)
            self.images.append((found.get("src") or "", found.get("alt") or ""))
        elif tag == "br":
            self._text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag in _BLOCKS:
            self._close()

    def handle_data(self, data: str) -> None:
        if not self._skip and self._tag:
            self._text.append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return reader


def text_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, tag, text) from (page_id, html); a null page has no block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), n, tag, text) for i, h in zip(batch.column(0), batch.column(1), strict=True) for n, (tag, text) in enumerate(read(h.as_py()).blocks)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["page_id", "block", "tag", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block int, tag string, text string")


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, index, headers, data): the first row of each table with at least two filled rows is its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h in zip(batch.column(0), batch.column(1), strict=True):
                for n, found in enumerate(read(h.as_py()).tables):
                    filled = [r for r in found if any(r)]
                    if len(filled) >= 2:
                        rows.append({"page_id": i.as_py(), "index": n + 1, "headers": filled[0], "data": filled[1:]})
            schema = pa.schema([("page_id", pa.int64()), ("index", pa.int32()), ("headers", pa.list_(pa.string())), ("data", pa.list_(pa.list_(pa.string())))])
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, index int, headers array<string>, data array<array<string>>")
