"""Joins beyond plain keys: zones, chains, cascades, global places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.dedup import written
from docweave.operators.order import running


def zones(rows: DataFrame, group: list[str], seq: str, start: str, name: str) -> DataFrame:
    """The last start at or before each row: the join with half-open zones that follow one another, for groups of any size."""
    return running(rows, group, seq, {name: ("max", F.col(start))})


def resolved(aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """(alias, root): targets followed to a fixpoint by doubling; cycles end as their smallest member that is reached.

    A target that is no alias is a root. Each round halves what is left of every chain.
    """
    now = written(aliases.select(F.col(alias).alias("alias"), F.col(target).alias("root")))
    while True:
        step = now.select(F.col("alias").alias("a2"), F.col("root").alias("r2"))
        nexts = written(now.join(step, F.col("root") == F.col("a2"), "left").select("alias", F.when(F.col("r2") == F.col("alias"), F.least("alias", "root")).otherwise(F.coalesce("r2", "root")).alias("root"), F.col("root").alias("was")))
        moved = nexts.filter(~F.col("root").eqNullSafe(F.col("was"))).limit(1).count()
        now = nexts.drop("was")
        if not moved:
            return now


def first_way(ways: list[DataFrame], key: str, found: str, how: str) -> DataFrame:
    """Per key the match of the first way (1, 2, ...) that has one, the smallest of several; aggregated map-side."""
    rows = ways[0].withColumn(how, F.lit(1))
    for k, w in enumerate(ways[1:], 2):
        rows = rows.unionByName(w.withColumn(how, F.lit(k)))
    best = rows.groupBy(key, how).agg(F.min(found).alias(found))
    return best.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(how))).filter("__n = 1").drop("__n")


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based place in the total order, without one task for all rows: ranges are ranked by themselves and shifted."""
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__c"))
    shift = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__shift"))  # a row per partition
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return ranked.join(shift, "__part").withColumn(name, (F.col("__r") + F.col("__shift")).cast("long")).drop("__part", "__r", "__shift")
