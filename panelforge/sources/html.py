"""Tables of HTML pages as rows of cells, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

CELLS = "table_no int, row_no int, col_no int, text string, heading string"


class _Reader(HTMLParser):
    """Collects (table, row, column, text, heading); a heading is the last h1 to h4 or the table's caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.table = self.row = self.col = -1
        self.depth, self.text, self.heading, self.into = 0, [], "", ""

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table, self.row = self.table + 1, -1
        elif tag == "tr" and self.depth:
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th") and self.depth:
            self._close()
            self.col += 1
            self.into, self.text = "cell", []
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.into, self.text = "heading", []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table", "h1", "h2", "h3", "h4", "caption"):
            self._close()
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.into:
            self.text.append(data)

    def _close(self):
        text = " ".join("".join(self.text).split())
        if self.into == "cell":
            self.cells.append((self.table, self.row, self.col, text, self.heading))
        elif self.into == "heading":
            self.heading = text
        self.into, self.text = "", []


def read_cells(html: str | None) -> list[tuple]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.cells


@udtf(returnType=CELLS)
class HtmlCells:
    """html_cells(html): the cells of all tables; nested tables belong to the outer one."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from read_cells(html)


def html_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The same for a column of pages, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *cell) for k, text in zip(frame[key], frame[html]) for cell in read_cells(text)]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in CELLS.split(", ")]])

    return pages.select(F.col(key).cast("bigint").alias(key), html).mapInPandas(run, f"{key} bigint, {CELLS}")
