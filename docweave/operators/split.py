"""Splitters that need state beyond an expression: recursive chunks over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Text cut at the first separator that it has, and at later ones where a piece is still longer than size; nothing is lost."""
    if len(text) <= size:
        return [text] if text else []
    sep, rest = separators[0], separators[1:]
    while sep and sep not in text:
        sep, rest = rest[0], rest[1:]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(sep)
    whole = [p + sep for p in parts[:-1]] + [parts[-1]]
    return [x for p in whole for x in pieces(p, size, rest)]


def chunk_spans(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters made of whole pieces; a chunk begins with up to overlap characters of whole pieces of the one before."""
    ends, at = [0], 0
    for p in pieces(text, size):
        at += len(p)
        ends.append(at)
    out, first = [], 0
    while first < len(ends) - 1:
        last = first + 1
        while last + 1 < len(ends) and ends[last + 1] - ends[first] <= size:
            last += 1
        out.append((ends[first], ends[last]))
        if last == len(ends) - 1:
            break
        back = last
        while back - 1 > first and ends[last] - ends[back - 1] <= overlap:
            back -= 1
        # The next chunk must reach beyond this one's end.
        while back < last and ends[last + 1] - ends[back] > size:
            back += 1
        first = back
    return out


def recursive_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id_col, no, start, end, text), cut at the coarsest separators that fit. Null or empty texts have no chunks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, start, end, out = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, (s, e) in enumerate(chunk_spans(text or "", size, overlap)):
                    at.append(i), no.append(k), start.append(s), end.append(e), out.append(text[s:e])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (no, start, end)), pa.array(out, pa.string())], [id_col, "no", "start", "end", "text"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"`{id_col}` {kind}, no int, start int, end int, text string")
