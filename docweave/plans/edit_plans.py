"""Events, upserts and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import edit
from docweave.plans.registry import query, table


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
s AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchases, date_diff('millisecond', min(ts), max(ts)) AS elapsed_ms FROM events GROUP BY user_id)
SELECT s.user_id, n_events, n_purchases, elapsed_ms, event_type AS last_stage FROM s JOIN e ON s.user_id = e.user_id AND n = 1""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    sums = e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("elapsed_ms"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return sums.select("user_id", "n_events", "n_purchases", "elapsed_ms", F.col("last.event_type").alias("last_stage"))


@query("""SELECT event_id, date_diff('millisecond', lag(ts) OVER w, ts) AS step_ms, date_diff('millisecond', min(ts) OVER (PARTITION BY user_id), ts) AS total_ms, row_number() OVER w <= 250 AS in_history
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", (ms - F.lag(ms).over(w)).alias("step_ms"), (ms - F.min(ms).over(Window.partitionBy("user_id"))).alias("total_ms"), (F.row_number().over(w) <= 250).alias("in_history"))


@query("""SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return edit.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"], ["value", "event_id"])


@query("""WITH o AS (SELECT doc_id, source || '-' || (doc_id % 7) AS code, n_chars AS v, 0 AS b FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '-' || (doc_id % 7) ELSE '' END, quality, 1 FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, CASE WHEN code <> '' THEN code ELSE '#' || doc_id END AS k FROM o) SELECT doc_id, code, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, doc_id DESC) AS n FROM k) WHERE n = 1""")
def recommendation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    code = F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string"))
    old = d.select("doc_id", code.alias("code"), F.col("n_chars").alias("v"))
    new = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 2 == 0, code).otherwise("").alias("code"), F.col("quality").cast("long").alias("v"))
    return edit.upsert(old, new, "code", "doc_id")


@query("""SELECT event_id FROM events WHERE json_extract_string(props, '$.editor') IS DISTINCT FROM 'me' AND user_id % 10 <> 3""")
def echo_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events but a client's own."""
    e = table(spark, sf, "events")
    return e.filter(~F.get_json_object("props", "$.editor").eqNullSafe(F.lit("me")) & (F.col("user_id") % 10 != 3)).select("event_id")


@query("""SELECT conv_id, CASE WHEN turn = 1 THEN 0 ELSE turn END AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY conv_id, CASE WHEN turn = 1 THEN 0 ELSE turn END"))
def merge_rows(spark: SparkSession, sf: str) -> DataFrame:
    return edit.merged(table(spark, sf, "conversations"), {1: 0}, "turn", "conv_id", "text")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'LARGE' ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 THEN 'large ' || p_name ELSE p_name END AS p_name FROM part""")
def regroup_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return edit.regrouped(p, F.col("p_size") > 40, {"p_brand": F.lit("LARGE"), "p_name": F.concat(F.lit("large "), F.col("p_name"))}).drop("p_size")


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high, CASE WHEN sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) = 0 THEN 'missing' WHEN sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) < count(*) THEN 'running' ELSE 'complete' END AS state FROM events GROUP BY user_id, event_type""")
def resume_state(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    return s.withColumn("state", F.when(F.col("high") == 0, "missing").when(F.col("high") < F.col("n"), "running").otherwise("complete"))
