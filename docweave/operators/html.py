"""HTML pages to blocks and cells. The tree walk is a Python leaf over Arrow batches; everything after it is DataFrame work."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(("h1", "h2", "h3", "h4", "p", "li"))
SKIPPED = frozenset(("script", "style", "head", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def feature_counts(html: Column) -> tuple[Column, Column]:
    """Numbers of cells and of paragraphs."""
    return F.regexp_count(html, F.lit(r"(?i)<t[dh][ >/]")), F.regexp_count(html, F.lit(r"(?i)<p[ >/]"))


def plain_text(html: Column) -> Column:
    """Scripts, styles, comments and tags out, white space collapsed; character references stay as written."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def compact(html: Column) -> Column:
    """Head matter, images and inline markup out; of attributes only spans and page numbers stay; empty paragraphs and rows out."""
    out = F.regexp_replace(html, r"(?is)<(script|style|title)\b[^>]*>.*?</(script|style|title)>", "")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->|<(meta|link|img)\b[^>]*>|</?(font|span|b|i|u|strong|em)\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<(?!/)([a-z][a-z0-9]*)\b(?:(?! (?:rowspan|colspan|data-page)=)[^>])*((?: (?:rowspan|colspan|data-page)=(?:\"[^\"]*\"|[^ >]*))*)[^>]*>", "<$1$2>")
    return F.regexp_replace(out, r"(?i)<(p|tr)>[ \t\n\x0B\f\r]*</(p|tr)>", "")


def spanned(value: str | None, most: int) -> int:
    """A span as the HTML standard reads it: 1 if it is no positive number, and bounded."""
    digits = re.match("[0-9]{1,9}", (value or "").strip())
    return min(max(1, int(digits[0])), most) if digits else 1


class Walk(HTMLParser):
    """Blocks (tag, text) outside tables, and tables as (rowspan, colspan, text) cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tables: list[list[list[list]]] = []
        self.open: list[list[list[list]]] = []
        self.tag, self.parts, self.skip = "", [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if self.tag and text:
            self.blocks.append((self.tag, text))
        self.tag, self.parts = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            span = dict(attrs)
            n = [spanned(span.get(k), most) for k, most in (("rowspan", 65534), ("colspan", 1000))]
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append([*n, ""])
        elif self.open:
            self.broken(tag)
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif self.open:
            self.broken(tag)
        elif not self.open and tag in BLOCKS and tag == self.tag:
            self.flush()

    def broken(self, tag: str) -> None:
        """A line of a cell ends at breaks and blocks."""
        if (tag in BLOCKS or tag in ("br", "div")) and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][2] += "\n"

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.open:
            if self.open[-1] and self.open[-1][-1]:
                self.open[-1][-1][-1][2] += re.sub(r"\s+", " ", data)
        elif self.tag:
            self.parts.append(data)


def walked(html: str | None) -> Walk:
    w = Walk()
    if html:
        w.feed(html)
        w.close()
        w.flush()
    return w


def dense(cells: list[list[list]]) -> list[list[str]]:
    """A table's grid with spans copied into every cell they cover, ragged rows padded."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(cells):
        c = 0
        for down, across, text in row:
            while (r, c) in grid:
                c += 1
            value = "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip())
            for i in range(min(down, len(cells) - r)):
                for j in range(across):
                    grid.setdefault((r + i, c + j), value)
            c += across
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(cells))]


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block, tag, text): headings, paragraphs and list items outside tables in page order; empty ones dropped."""
    kind = pages.schema[page_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, block, tag, text = [], [], [], []
            for i, page in enumerate(b.column("html").to_pylist()):
                for k, (t, x) in enumerate(walked(page).blocks):
                    at.append(i), block.append(k), tag.append(t), text.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(block, pa.int32()), pa.array(tag, pa.string()), pa.array(text, pa.string())], [page_id, "block", "tag", "text"])

    return pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).mapInArrow(scan, f"{page_id} {kind}, block int, tag string, text string")


def cells(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, table, row, col, text): all cells of all tables, spans expanded; lines of a cell end at breaks and blocks."""
    kind = pages.schema[page_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, r, c, x) for i, page in enumerate(b.column("html").to_pylist()) for k, t in enumerate(walked(page).tables) for r, row in enumerate(dense(t)) for c, x in enumerate(row)]
            at, table, row, col, text = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (table, row, col)), pa.array(text, pa.string())], [page_id, "table", "row", "col", "text"])

    return pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).mapInArrow(scan, f"{page_id} {kind}, table int, row int, col int, text string")


def table_text(rows: list[list[str]]) -> str:
    """A grid as a pipe table."""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]) if rows else ""


def pipe_rows(text: str) -> list[list[str]]:
    """Rows of a pipe table, its separator left out."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.splitlines() if line.strip().startswith("|")]
    return [r for r in rows if not all(re.fullmatch(r":?-{3,}:?", c) for c in r)]
