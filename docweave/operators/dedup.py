"""Distinct rows, duplicate edges, components and label canonicalisation."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text as tx

#: ASCII bytes that a signature has not; any run of characters that it has not.
NOT_ASCII_SIG = bytes(b for b in range(128) if not chr(b).isalnum())
NOT_SIG = re.compile("[^0-9A-Za-z가-힣]+")

_own_dir: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; where the setting is missing, a local master gets one of its own."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own_dir = _own_dir or tempfile.mkdtemp(prefix="docweave-")
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share, read again: cuts lineage for loops."""
    path = f"{shared_folder(df.sparkSession)}/loops/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(text: bytes) -> bytes:
    """`text.sig` of a text in UTF-8; broken bytes go."""
    if text.isascii():
        return text.translate(None, NOT_ASCII_SIG)
    try:
        text.decode()
    except UnicodeDecodeError:
        return NOT_SIG.sub("", text.decode(errors="replace")).encode()
    # Most of what goes is ASCII; a pattern would stop at each run of it.
    return NOT_SIG.sub("", text.translate(None, NOT_ASCII_SIG).decode()).encode()


def signature_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, digest): SHA-256 of each text's signature; rows whose signature is empty, or text null, go. Each text is read once."""
    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("digest", T.BinaryType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = (signature(t.as_py()) if t.is_valid else b"" for t in batch["text"])
            found = pa.array([hashlib.sha256(s).digest() if s else None for s in sigs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], found], names=[id_col, "digest"]).filter(found.is_valid())

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(digests, kind)


def distinct_first(df: DataFrame, key: list[Column | str], seq: str) -> DataFrame:
    """The row with the smallest seq of each key; rows with an empty or null key go. Rows equal in key and seq all stay.

    The winners' seq are found with map-side aggregation, so that a frequent key is not sorted in one task.
    """
    keyed = df.select("*", *(k.alias(f"__k{i}") if isinstance(k, Column) else F.col(k).alias(f"__k{i}") for i, k in enumerate(key)))
    names = [f"__k{i}" for i in range(len(key))]
    for n in names:
        keyed = keyed.filter(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    first = keyed.groupBy(*names).agg(F.min(seq).alias("__first")).select(*(F.col(n).alias(f"{n}_") for n in names), "__first")
    same = keyed[seq] == F.col("__first")
    for n in names:
        same = same & (F.col(n) == F.col(f"{n}_"))
    return keyed.join(first, same, "left_semi").drop(*names)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over the edges (a, b). Rounds grow with the log of the graph's size."""
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select("u", "u").distinct())
        before = mark
        both = now.select("v", "u").union(now.select("u", "v")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("l")).select("n", F.least("n", "l").alias("l"))
        large = both.join(low, "n").filter("m > n").select(F.col("m").alias("v"), F.col("l").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("l"))
        hung = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("l").alias("u")), F.struct(F.col("u").alias("v"), F.col("l").alias("u")))).alias("e"))
        now = written(hung.select("e.v", "e.u").filter("v <> u").distinct())


def shingle_pairs(df: DataFrame, key: str, block: str, shingles: Column, least: float = 0.8) -> DataFrame:
    """(block, a, b, similarity): pairs with a Jaccard of at least `least`, by prefix filtering.

    Of n shingles in a fixed order, rarest first, two sets that similar share one among the first n - ceil(least n) + 1;
    only those are joined, and what two texts share of these, with the places, bounds how far the whole sets can agree; the
    few pairs left are compared as whole sets. shingles are hashes; texts that are equal are one representative.
    """
    sets = df.select(F.col(key).alias("id"), F.col(block).alias("block"), F.array_distinct(shingles).alias("s")).filter(F.size("s") > 0)
    each = sets.select("id", "block", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = each.groupBy("block", "h").agg(F.count("*").alias("df"))
    shared = often.filter("df > 1")
    ranked = each.join(often, ["block", "h"]).groupBy("block", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    kept = F.slice("hs", 1, F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1)
    prefix = ranked.select("block", "id", "n", F.posexplode(kept).alias("i", "p")).select("block", "id", "n", "i", F.col("p.h").alias("h")).join(shared.select("block", "h"), ["block", "h"], "left_semi")
    x, y = prefix.alias("x"), prefix.alias("y")
    cand = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9))
    met = cand.groupBy(F.col("x.block").alias("block"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("m"), *(F.max(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in "ni"))
    # Up to where the first of the two beginnings ends, all that is shared is known; the rest of it is a difference.
    room = [F.col(f"{s}n") - (F.col("xn") + F.col("yn")) * F.lit(least / (1 + least)) + 1e-6 + F.col("m") for s in "xy"]
    ends = [F.col(f"{s}n") - F.ceil(F.col(f"{s}n") * F.lit(least) - 1e-9) + 1 for s in "xy"]
    cand = met.filter(((ends[0] <= room[0]) & (F.col("yi") + 1 <= room[1])) | ((F.col("xi") + 1 <= room[0]) & (ends[1] <= room[1]))).select("block", "a", "b")
    hs = ranked.select("id", F.transform("hs", lambda x: x["h"]).alias("hs"))
    full = cand.join(hs.withColumnRenamed("hs", "ha"), F.col("a") == F.col("id")).drop("id").join(hs.withColumnRenamed("hs", "hb"), F.col("b") == F.col("id")).drop("id")
    return full.withColumn("similarity", F.round(tx.jaccard(F.col("ha"), F.col("hb")), 6)).filter(F.col("similarity") >= least).select("block", "a", "b", "similarity")


def substring_merge(labels: DataFrame, label: str, n: str) -> DataFrame:
    """(label, n, merged): each label that another one contains takes the shortest such label (then the first by value).

    labels has one row per distinct label: a dictionary that is held against itself.
    """
    long = labels.select(F.col(label).alias("long"))
    hit = labels.join(long, F.col("long").contains(F.col(label)) & (F.length("long") > F.length(label)) & (F.length(label) > 0))
    best = hit.groupBy(label).agg(F.min(F.struct(F.length("long").alias("l"), "long")).alias("m"))
    return labels.join(best, label, "left").select(label, n, F.coalesce(F.col("m.long"), F.col(label)).alias("merged"))
