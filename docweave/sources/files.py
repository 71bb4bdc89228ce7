"""Readers: files of documents, texts, HTML, a JSON catalog; and what is derived from their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beginnings of files, and extensions, by kind.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0"}
EXTENSIONS = {"pdf": "pdf", "docx": "zip", "hwpx": "zip", "xlsx": "zip", "doc": "ole", "hwp": "ole", "html": "html", "htm": "html", "txt": "text", "json": "json"}

CATALOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "대분류", "중분류", "소분류", "솔루션명", "설명")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("강점", "한계", "레퍼런스")]
)


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file below path: path, kind, length, digest and content. Kinds go by extension, then by the first bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", kind_of("path", "content").alias("kind"), "length", "modificationTime", F.sha2("content", 256).alias("digest"), "content")


def kind_of(path: str, content: str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    begin = F.hex(F.substring(content, 1, 4))
    sniffed = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        sniffed = F.when(begin == magic, kind).otherwise(sniffed)
    named = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))[ext]
    # doc and docx are often swapped: there the bytes decide.
    return F.when(ext.isin("doc", "docx"), F.coalesce(sniffed, named)).otherwise(F.coalesce(named, sniffed))


def cache_key(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(source_file, text) of text files, each one whole."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; where that is not valid, as the Korean code page."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, cp949(content))


@F.pandas_udf(T.StringType())
def cp949(content):
    import pandas as pd

    return pd.Series([None if b is None else bytes(b).decode("cp949", "replace") for b in content], dtype=object)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries; of entries with one id the last in the file stays, nulls in lists are dropped."""
    raw = spark.read.schema(CATALOG).option("multiLine", "true").json(path)
    placed = raw.withColumn("seq", F.monotonically_increasing_id())  # one file, read by one task, in order
    best = placed.groupBy("id").agg(F.max_by(F.struct(*CATALOG.names[1:]), "seq").alias("e"), F.min("seq").alias("seq"))
    return best.select("id", "e.*", "seq")


def embedding_text() -> Column:
    """What of an entry is searched: its non-empty parts, lists joined by commas."""
    parts = [F.col(c) for c in CATALOG.names[1:6]] + [F.array_join(F.col(c), ", ") for c in CATALOG.names[6:]]
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x != "", F.lit(False))), "\n")
