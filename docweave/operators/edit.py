"""Edits and stores: upserts, latest state, merges, regrouping, and a cache partitioned by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], seq: list[str], values: list[str]) -> DataFrame:
    """The values of the last entry of each key; aggregated map-side, so a busy key is no large group."""
    order = F.struct(*seq)
    best = F.max(F.struct(order.alias("__o"), F.struct(*values).alias("__v"))).alias("__b")
    return log.groupBy(*key).agg(best).select(*key, *(F.col(f"__b.__v.{v}").alias(v) for v in values))


def upsert(old: DataFrame, new: DataFrame, key: str, fallback: str) -> DataFrame:
    """Union in which new rows win by key; rows without a key count by the fallback column. Within a batch the last by fallback wins."""
    k = F.coalesce(F.when(F.col(key).cast("string") != "", F.col(key).cast("string")), F.concat(F.lit("#"), F.col(fallback).cast("string")))
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1))).withColumn("__k", k)
    return latest(both, ["__k"], ["__b", fallback], old.columns).select(*old.columns)


def merged(rows: DataFrame, into: dict[int, int], seq: str, group: str, text: str) -> DataFrame:
    """Rows whose seq is a key of `into` are appended, by newline and in order, to the row it names."""
    to = F.col(seq)
    for a, b in into.items():
        to = F.when(F.col(seq) == a, b).otherwise(to)
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return rows.groupBy(group, to.alias("__to")).agg(parts.alias("__p")).select(group, F.col("__to").alias(seq), F.array_join(F.transform("__p", lambda x: x["t"]), "\n").alias(text))


def regrouped(rows: DataFrame, chosen: Column, columns: dict[str, Column]) -> DataFrame:
    """Chosen rows get new values in the given columns."""
    out = rows
    for c, v in columns.items():
        out = out.withColumn(c, F.when(F.coalesce(chosen, F.lit(False)), v).otherwise(F.col(c)))
    return out


def save_version(df: DataFrame, path: str, version: int, key: str) -> None:
    """A cache version partitioned by the beginning of its content key; saving again replaces only the partitions it has."""
    out = df.withColumn("cache_version", F.lit(version)).withColumn("bucket", F.substring(F.col(key), 1, 2))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_version", "bucket").parquet(path)


def load_version(spark, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("cache_version") == version).drop("bucket", "cache_version")
