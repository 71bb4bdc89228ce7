"""Stage events as streams: latest state, timing with history, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 250
TIMED = "user_id long, event_id long, event_type string, step_ms long, total_ms long, n_history int"
STATE = "first_ms long, last_ms long, n int"


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key so far (update or complete mode)."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")
    return events.groupBy(key).agg(last, F.count("*").alias("n")).select(key, "n", "last.ts", "last.event_id", "last.event_type", "last.value")


def windowed(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per time window and type; events later than `late` are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def timed(events: DataFrame) -> DataFrame:
    """Each event with the time since the one before and since the first of its user, across micro-batches.

    The state of a user is three numbers, whatever the length of the history; n_history stops at HISTORY.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        out = []
        for r in rows.itertuples():
            ms = int(r.ms)
            first = ms if first is None else first
            n = min(HISTORY, n + 1)
            out.append((int(key[0]), int(r.event_id), r.event_type, None if last is None else ms - last, ms - first, n))
            last = ms
        state.update((first, last, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "step_ms", "total_ms", "n_history"]).astype({"step_ms": "Int64"})

    slim = events.select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return slim.groupBy("user_id").applyInPandasWithState(step, TIMED, STATE, "append", GroupStateTimeout.NoTimeout)


def upserting(events: DataFrame, path: str, key: list[str], seq: str, checkpoint: str):
    """A query that keeps the latest row of each key in versions below path: each batch writes the next version, once."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n:
            rows = spark.read.parquet(f"{path}/v={n - 1}").unionByName(batch)
        last = F.max(F.struct(seq, F.struct(*(c for c in batch.columns if c not in key)).alias("r"))).alias("m")
        out = rows.groupBy(*key).agg(last).select(*key, "m.r.*")
        out.write.mode("overwrite").parquet(f"{path}/v={n}")  # a repeated batch replaces its own version

    return events.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
