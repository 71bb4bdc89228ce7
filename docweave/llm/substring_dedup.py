"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes of a whole text cuts wherever its value is small. Where it is small depends on
the 16 bytes before only; a cut is left out within LEAST bytes of the one before and forced after MOST bytes, and that
state is forgotten at the next cut that both texts take. So an insertion shifts text, but not the cuts a little beyond it,
and the same passage falls into the same chunks in any document. Chunks are compared by a 128-bit digest; the first
document (smallest doc_id) with a chunk keeps it, all later ones, and repeats within a document, are duplicates. Adjacent
duplicate chunks of a document form a span; spans of at least MIN_SPAN bytes are reported and can be cut out.

Texts are chunked once, and the chunks written. Digests are counted with map-side aggregation; those found twice are
written too, and joined to the chunks as two plain exchanges, so that a partition with the digest of a passage in a third
of all documents is split by the adaptive plan: it is neither gathered in one task nor paired with itself.

Defined cases: null or empty texts have no chunks; rows with the same doc_id are one document for the choice of the first;
rows without doc_id never keep a chunk that a row with one has, and keep it if there is none; an empty table gives no
spans; a passage that shares fewer than MIN_SPAN bytes of whole chunks with another document is not reported, nor one in a
stretch without cuts (a word repeated for hundreds of words) that begins elsewhere in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import free_name, staged

#: Mean bytes between cuts, and bounds of a chunk.
MEAN, LEAST, MOST = 40, 16, 512
#: Bytes of adjacent duplicate chunks that make a span.
MIN_SPAN = 100
#: Bytes that a cut depends on: bits of the rolling hash.
REACH = 16


def gear(seed: int = 7) -> np.ndarray:
    """256 16-bit values from a fixed rule."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFF for b in range(256)], np.uint16)


GEAR = gear()


def cuts(data: bytes, mean: int = MEAN) -> list[int]:
    """Ends of the chunks of data; the last is its length."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    reach = 1
    while reach < REACH:  # h[i] covers `reach` bytes up to i; doubled each time
        moved = h[:-reach] << np.uint16(reach)
        h = h.copy()
        h[reach:] += moved
        reach *= 2
    small = h < 65536 // mean
    small[:-1] &= (raw[1:] & 0xC0) != 0x80  # never within a character
    ends, start = [], 0
    for at in (np.flatnonzero(small) + 1).tolist():
        while at - start > MOST:
            start = forced(raw, start)
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while len(data) - start > MOST:
        start = forced(raw, start)
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def forced(raw: np.ndarray, start: int) -> int:
    """The end of a chunk that reaches its bound, at a character's end."""
    at = start + MOST
    while at > start + 1 and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(text: str) -> tuple[list[int], list[bytes]]:
    """Ends and digests of a text's chunks."""
    data = text.encode()
    ends = cuts(data)
    digest = xxhash.xxh3_128_digest
    return ends, [digest(data[a:b]) for a, b in zip([0, *ends], ends)]


def repeats(digests: list[bytes]) -> list[bool]:
    seen: set[bytes] = set()
    return [d in seen or bool(seen.add(d)) for d in digests]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, seq, at, n, h1, h2, again): all chunks; key tells rows apart, again marks repeats within the row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                ends, digests = chunked(text)
                ends = np.array(ends, np.int32)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int32)
                made = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                parts.append((starts, ends - starts, made[:, 0], made[:, 1], np.array(repeats(digests)), np.arange(len(ends), dtype=np.int32)))
                rows.append(np.full(len(ends), i))
            if not rows:
                continue
            at, n, h1, h2, again, seq = (np.concatenate(x) for x in zip(*parts))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), pa.array(seq), pa.array(at), pa.array(n), pa.array(h1), pa.array(h2), pa.array(again)], ["id", "key", "seq", "at", "n", "h1", "h2", "again"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, f"id {kind}, key long, seq int, at int, n int, h1 long, h2 long, again boolean")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_SPAN) -> DataFrame:
    """(id_col, key, start, end, first_id): duplicate spans in bytes; first_id is the document that keeps the span's first chunk."""
    all_chunks = staged(chunks(docs, id_col, text_col), "chunks")
    seen = all_chunks.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("id").alias("first_id")).filter("times > 1").select("h1", "h2", "first_id")
    found = all_chunks.join(staged(seen, "shared_chunks"), ["h1", "h2"])
    later = F.col("again") | F.when(F.col("id").isNull(), F.col("first_id").isNotNull()).otherwise(F.col("id") != F.col("first_id"))
    found = found.filter(later).select("id", "key", "seq", "at", "n", "first_id").distinct()
    row = Window.partitionBy("id", "key").orderBy("seq")
    runs = found.withColumn("run", F.col("seq") - F.row_number().over(row))
    out = runs.groupBy("id", "key", "run").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"), F.min(F.struct("seq", "first_id")).alias("f"))
    return out.filter(F.col("end") - F.col("start") >= least).select(F.col("id").alias(id_col), "key", "start", "end", F.col("f.first_id").alias("first_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_SPAN) -> DataFrame:
    """docs with the duplicate spans cut out of the text, all columns and rows kept (a text may become empty)."""
    key, cut_at = free_name(docs, "text_key"), free_name(docs, "cut_at")
    per_row = spans(docs, id_col, text_col, least).groupBy(F.col(id_col).alias("span_id"), F.col("key").alias("span_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_at))

    @F.pandas_udf("string")
    def cut(texts, places):
        import pandas as pd

        out = []
        for text, spans_ in zip(texts, places):
            if text is None or spans_ is None:
                out.append(text)
                continue
            data, at, kept = text.encode(), 0, []
            for s in spans_:
                kept.append(data[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(key, F.xxhash64(F.col(text_col))).join(per_row, F.col(id_col).eqNullSafe(F.col("span_id")) & (F.col(key) == F.col("span_key")), "left")
    return joined.select(*(cut(F.col(text_col), F.col(cut_at)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
