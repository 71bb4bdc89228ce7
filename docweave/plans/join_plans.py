"""Joins: reviews, anti-joins, intervals, alias chains, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import joins, quality
from docweave.plans.registry import query, table


@query("""SELECT d.doc_id, d.source, l.quality, CASE WHEN l.toxic = 1 THEN 'X' WHEN l.toxic = 0 THEN 'O' ELSE '' END AS mark, l.doc_id IS NULL AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def review_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn("__has", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return d.select("doc_id", "source", "quality", F.when(F.col("toxic") == 1, "X").when(F.col("toxic") == 0, "O").otherwise("").alias("mark"), F.col("__has").isNull().alias("pending"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""WITH z AS (SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b, event_type FROM events WHERE event_type IN (SELECT min(event_type) FROM events))
SELECT e.event_id, z.a AS zone FROM events e JOIN z ON e.user_id = z.user_id AND e.event_id >= z.a AND (z.b IS NULL OR e.event_id < z.b)""")
def zone_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to the half-open zone that holds them; zones that do not overlap need no range join, the last start is carried."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    least = e.agg(F.min("event_type").alias("least"))
    starts = e.crossJoin(F.broadcast(least)).select("user_id", "event_id", F.when(F.col("event_type") == F.col("least"), F.col("event_id")).alias("start"))  # least is one row
    return joins.zones(starts, ["user_id"], "event_id", "start", "zone").filter("zone IS NOT NULL").select("event_id", "zone")


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE p_partkey - 1 END AS p FROM part), r AS (SELECT k, p FROM m UNION SELECT r.k, m.p FROM r JOIN m ON r.p = m.k)
SELECT k AS p_partkey, min(p) AS root FROM r GROUP BY k""")
def alias_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases followed to their end."""
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k.alias("alias"), F.when(k % 10 == 0, k).otherwise(k - 1).alias("target"))
    return joins.resolved(m, "alias", "target").select(F.col("alias").alias("p_partkey"), F.col("root"))


@query("""WITH q AS (SELECT item_id, regexp_extract(text, '^[^ ]+') AS w FROM benchmark), c AS (
 SELECT item_id, doc_id, 1 AS how FROM q JOIN (SELECT doc_id, regexp_extract(text, '^[^ ]+') AS w FROM documents) d USING (w)
 UNION ALL SELECT item_id, doc_id, 2 FROM q JOIN (SELECT doc_id, lower(regexp_extract(text, '^[^ ]+')) AS w FROM documents) d ON lower(q.w) = d.w
 UNION ALL SELECT item_id, item_id, 3 FROM q JOIN documents ON item_id = doc_id)
SELECT item_id, doc_id, CAST(how AS INTEGER) AS how FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY how, doc_id) AS n FROM c) WHERE n = 1""")
def verdict_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first way that matches: exact first word, the same without case, the same position."""
    word = F.regexp_extract("text", "^[^ ]+", 0)
    q = table(spark, sf, "benchmark").select("item_id", word.alias("w"))
    d = table(spark, sf, "documents").select("doc_id", word.alias("v"))
    ways = [q.join(d, F.col("w") == F.col("v")), q.join(d, F.lower("w") == F.lower("v")), q.join(d, F.col("item_id") == F.col("doc_id"))]
    return joins.first_way([x.select("item_id", "doc_id") for x in ways], "item_id", "doc_id", "how")


@query("""SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def adaptive_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Only columns that some row fills: here quality and toxic are, note is not."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("note", F.lit(" "))
    return rows.select("doc_id", *quality.filled_columns(rows, ["quality", "toxic", "note"]))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END, 1000000), o_orderkey) AS place FROM orders""")
def document_order(spark: SparkSession, sf: str) -> DataFrame:
    """Document order (page, missing last, then code) as a number, over range partitions."""
    page = F.coalesce(F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_custkey")), F.lit(1_000_000))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", page.alias("page"))
    return joins.placed(rows, ["page", "o_orderkey"], "place").select("o_orderkey", "o_custkey", "place")


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS tab FROM orders) SELECT o_orderkey, CAST(coalesce(n, 999) AS INTEGER) AS tab_rank FROM orders LEFT JOIN (SELECT '1-URGENT' AS tab, 1 AS n UNION ALL SELECT '3-MEDIUM', 2) ON tab = o_orderpriority""")
def declared_rank(spark: SparkSession, sf: str) -> DataFrame:
    ranks = spark.createDataFrame([("1-URGENT", 1), ("3-MEDIUM", 2)], "tab string, n int")
    o = table(spark, sf, "orders").join(F.broadcast(ranks), F.col("tab") == F.col("o_orderpriority"), "left")  # two rows
    return o.select("o_orderkey", F.coalesce("n", F.lit(999)).alias("tab_rank"))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY o_custkey""")
def top3_report(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    rows = F.sort_array(F.collect_list(F.struct("n", F.col("o_orderkey").cast("string").alias("k"))))
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["k"]), ",").alias("top"))
