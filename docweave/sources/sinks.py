"""Writers: tables by tab, JSON, and ordered workbooks of tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_tab(df: DataFrame, path: str, tab: str, order: list[str]) -> None:
    """A Parquet folder per tab, rows in order within each file."""
    df.repartition(F.col(tab), F.pmod(F.xxhash64(*order), F.lit(16))).sortWithinPartitions(tab, *order).write.mode("overwrite").partitionBy(tab).parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fixed_columns(df: DataFrame, columns: list[str], images: str | None = None) -> DataFrame:
    """The fixed columns as text, blanks for nulls; rows with several images are repeated for each."""
    out = df.withColumn("image", F.explode_outer(images)) if images else df
    return out.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns), *(["image"] if images else []))


def level_columns(df: DataFrame, tab: str, levels: str, names: str = "level") -> DataFrame:
    """levels as columns level_1 ... level_n, n being the greatest depth; and each row's depth in its tab."""
    deepest = df.agg(F.max(F.size(levels))).first()[0] or 0
    depth = F.max(F.size(levels)).over(Window.partitionBy(tab))
    return df.withColumn("tab_depth", depth).select("*", *(F.coalesce(F.get(F.col(levels), F.lit(i)), F.lit("")).alias(f"{names}_{i + 1}") for i in range(max(0, deepest))))


def masked_by_mode(df: DataFrame, mode: str, model: list[str], human: list[str]) -> DataFrame:
    """In mode "human" the model's columns are blank, in mode "model" the human's; in "both" none."""
    hidden = set(model if mode == "human" else human if mode == "model" else [])
    return df.select(*(F.lit("").alias(c) if c in hidden else F.col(c) for c in df.columns))


def sheet_name(label: Column) -> Column:
    """At most 31 characters, without the marks that sheet names can't have."""
    return F.substring(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\[\]:*?/\\]", " "), 1, 31)
