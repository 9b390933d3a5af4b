"""Tables of HTML pages as cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, table_id int, row int, column int, text string, header boolean, spanned boolean"


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.open: list[list[list[dict]]] = []
        self.cell: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            a = dict(attrs)
            self.cell.append({"text": [], "header": tag == "th", "spanned": any(a.get(k, "1") not in ("1", None) for k in ("rowspan", "colspan"))})
            self.open[-1][-1].append(self.cell[-1])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell:
            self.cell.pop()
        elif tag == "table" and self.open:
            self.open.pop()
            self.cell = self.cell[: len(self.open)]

    def handle_data(self, data):
        if self.cell:
            self.cell[-1]["text"].append(data)


def cells_of(html: str | None) -> list[tuple[int, int, int, str, bool, bool]]:
    """Table, row, column, trimmed text, whether it is a header, whether it spans more than one place."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    return [(t, r, c, "".join(cell["text"]).strip(), cell["header"], cell["spanned"]) for t, rows in enumerate(p.tables) for r, row in enumerate(rows) for c, cell in enumerate(row)]


def table_cells(pages: DataFrame, strict: bool = False) -> DataFrame:
    """A row a cell of every table; with strict, a cell that spans several places is refused."""

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = cells_of(html)
                if strict and any(f[5] for f in found):
                    raise ValueError(f"page {page_id} has cells that span several places")
                rows += [(page_id, *f) for f in found]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "table_id", "row", "column", "text", "header", "spanned"])

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)
