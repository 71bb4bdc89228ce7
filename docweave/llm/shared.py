"""What the operators of this subpackage share: staging, key columns, free names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Of each open scratch(), the folders written within.
_scratch: list[list[str]] = []


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local master gets a folder of its own; on a cluster it must be set."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="docweave-")
    return _own_dir


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Within scratch() the table goes when that ends, unless keep.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged within, once no result depends on it."""
    _scratch.append([])
    try:
        yield
    finally:
        for at in _scratch.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as soon as it has run, rather than when the driver next collects garbage.

    For steps that stage their tables: a plan is not run twice there.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based global rank by the order columns, without one task that holds all rows.

    Rows are dealt out by range, written once, ranked within their range, and shifted by what the ranges before hold.
    The table of ranges has one row per partition.
    """
    from pyspark.sql import Window

    part, rank, before = (free_name(df, x) for x in ("part", "rank_in_part", "rows_before"))
    dealt = staged(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    shift = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranked.join(shift, part).withColumn(name, F.col(rank) + F.col(before)).drop(part, rank, before)
