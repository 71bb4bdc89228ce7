"""Statistics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import joins, quality
from docweave.plans.registry import query, table


@query(r"""WITH g AS (SELECT p_brand AS tab, p_partkey AS r, unnest(['name', 'type', 'size', 'code']) AS col, unnest([p_name, p_type, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, replace(p_brand, '#', '-')]) AS x FROM part),
s AS (SELECT *, trim(x) <> '' AS f, coalesce(lag(x) OVER (PARTITION BY tab, col ORDER BY r) = x, false) AND trim(x) <> '' AS again FROM g)
SELECT tab, col, count(*) AS n_cells, round(avg(CAST(f AS INTEGER)), 6) AS filled, round(avg(CASE WHEN f THEN length(trim(x)) END), 6) AS mean_length, max(CASE WHEN f THEN length(trim(x)) END) AS longest,
 round(avg(CASE WHEN f THEN CAST(length(trim(x)) <= 12 AND regexp_matches(trim(x), '^[A-Za-z0-9가-힣]{0,6}[_\-/.]?[0-9]{1,4}$') AS INTEGER) END), 6) AS codes,
 round(avg(CASE WHEN f THEN CAST(regexp_matches(trim(x), '^[0-9.,%-]+$') AS INTEGER) END), 6) AS numeric, round(avg(CAST(again AS INTEGER)), 6) AS repeats FROM s GROUP BY tab, col""")
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_size").cast("string"))
    cells = F.array(*(F.struct(F.lit(k).alias("col"), v.alias("x")) for k, v in {"name": F.col("p_name"), "type": F.col("p_type"), "size": size, "code": F.replace("p_brand", F.lit("#"), F.lit("-"))}.items()))
    grid = table(spark, sf, "part").select(F.col("p_brand").alias("tab"), F.col("p_partkey").alias("r"), F.inline(cells))
    return quality.column_stats(grid, "tab", "col", "r", "x")


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || '-' || (event_id % 3) END AS rid, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS tab, CASE WHEN event_id % 13 = 0 THEN '' ELSE props END AS detail FROM events),
m AS (SELECT *, trim(detail) = '' AS d, trim(tab) = '' AS t, trim(rid) <> '' AND event_id > min(event_id) OVER (PARTITION BY user_id, rid) AS i, trim(tab) <> '' AND coalesce(tab = lag(tab) OVER (PARTITION BY user_id ORDER BY event_id), false) AS l FROM r)
SELECT unnest(['empty_detail', 'empty_tab', 'duplicate_id', 'redundant_label']) AS kind, unnest([count(*) FILTER (d), count(*) FILTER (t), count(*) FILTER (i), count(*) FILTER (l)]) AS n FROM m""")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(e % 7 == 0, "").otherwise(F.concat("event_type", F.lit("-"), (e % 3).cast("string"))).alias("rid"), F.when(e % 11 == 0, " ").otherwise(F.col("event_type")).alias("tab"), F.when(e % 13 == 0, "").otherwise(F.col("props")).alias("detail"))
    return quality.consistency(rows.withColumn("label", F.col("tab")), "user_id", "event_id", "rid", "tab", "detail", "label")


@query("""WITH d AS (SELECT source, doc_id, coalesce(length(text), 0) AS l, n_chars % 40 AS page FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY l) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, max(page) OVER (PARTITION BY source ORDER BY doc_id) AS top FROM d)
SELECT source, max(n) AS n_rows, round((max(CASE WHEN k = (n - 1) // 2 THEN l END) + max(CASE WHEN k = n // 2 THEN l END)) / 2, 6) AS median_length, max(CASE WHEN k = CAST(floor(n * 0.9) AS BIGINT) THEN l END) AS p90_length, max(l) AS max_length,
 CAST(sum(CASE WHEN l > 300 THEN 1 ELSE 0 END) AS BIGINT) AS n_over_300, CAST(sum(CASE WHEN l > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS n_over_1000, count(*) FILTER (page < top) AS n_behind FROM o GROUP BY source""")
def human_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("page", F.col("n_chars") % 40)
    return quality.length_profile(d, "source", "text", "page", "doc_id")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_linenumber % 4 <> 0), m AS (SELECT *, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS m FROM s)
SELECT l_orderkey, CAST(n + 1 AS INTEGER) AS first, CAST(m - 1 AS INTEGER) AS last FROM m WHERE m > n + 1""")
def numbering_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numbering_gaps(table(spark, sf, "lineitem").filter("l_linenumber % 4 <> 0"), "l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT CASE WHEN role = 'user' THEN 'large-mini' WHEN role = 'assistant' THEN 'large' ELSE 'other' END AS model, length(text) AS i, length(text) // 2 AS o FROM conversations),
s AS (SELECT model, count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out FROM c GROUP BY model)
SELECT *, round((tokens_in * CASE WHEN model LIKE '%large%' THEN 5.0 ELSE 3.0 END + tokens_out * CASE WHEN model LIKE '%large%' THEN 15.0 ELSE 12.0 END) / 1e6, 4) AS cost FROM s""")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("role") == "user", "large-mini").when(F.col("role") == "assistant", "large").otherwise("other")
    calls = table(spark, sf, "conversations").select(model.alias("model"), F.length("text").alias("i"))
    return quality.usage(calls, "model", F.col("i"), F.floor(F.col("i") / 2), [("large", 5.0, 15.0), ("large-mini", 1.0, 3.0)])


@query("""SELECT coalesce(source, '') AS label, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1""")
def category_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


@query("""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_runs, round(count(*) / count(DISTINCT o_orderpriority), 6) AS breadth FROM orders GROUP BY o_orderstatus""")
def span_breadth(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderpriority").alias("n_runs"))
    return o.withColumn("breadth", F.round(F.col("n_rows") / F.col("n_runs"), 6))


@query("""WITH t AS (SELECT source, count(*) AS n, min(doc_id) AS first, median(n_chars) AS mid FROM documents GROUP BY source)
SELECT source, n, first, round(mid, 6) AS mid, row_number() OVER (ORDER BY mid, source) AS place FROM t""")
def tab_median_order(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.median("n_chars").alias("m"))
    return joins.placed(t, ["m", "source"], "place").select("source", "n", "first", F.round("m", 6).alias("mid"), "place")
