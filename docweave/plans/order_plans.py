"""Ordered state: numbers, carry-forward, islands, clamps, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import order
from docweave.plans.registry import query, table


@query("""SELECT p_partkey, upper(substring(regexp_replace(p_brand, '[^A-Za-z0-9]+', '', 'g'), 1, 4)) || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS code
FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")
def code_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return order.codes(table(spark, sf, "part"), "p_brand", "p_partkey", tx.code_prefix(F.col("p_brand"))).select("p_partkey", "code")


@query("""WITH t AS (SELECT DISTINCT o_orderpriority AS tab FROM orders),
s AS (SELECT tab, upper(substring(regexp_replace(tab, '[^A-Za-z]+', '', 'g'), 1, 1)) AS slug FROM t),
p AS (SELECT tab, slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY tab) = 1 THEN '' ELSE CAST(row_number() OVER (PARTITION BY slug ORDER BY tab) AS VARCHAR) END AS prefix FROM s)
SELECT o_orderkey, prefix || '-' || CAST(row_number() OVER (PARTITION BY tab ORDER BY o_orderkey) AS VARCHAR) AS rid FROM orders JOIN p ON tab = o_orderpriority""")
def tab_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A prefix per tab (slugs that collide get 2, 3, ...), and running ids within the tab."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tab"))
    tabs = orders.select("tab").distinct().withColumn("slug", F.upper(F.substring(F.regexp_replace("tab", "[^A-Za-z]+", ""), 1, 1)))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("slug").orderBy("tab"))
    prefixes = tabs.select("tab", F.concat("slug", F.when(n == 1, "").otherwise(n.cast("string"))).alias("prefix"))
    return order.numbered(orders, ["tab"], "o_orderkey").join(prefixes, "tab").select("o_orderkey", F.concat("prefix", F.lit("-"), F.col("n").cast("string")).alias("rid"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN fixed THEN 'DOC-' || l_linenumber ELSE 'REQ-' || lpad(CAST(sum(CASE WHEN fixed THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS VARCHAR), 3, '0') END AS code
FROM (SELECT *, l_returnflag = 'R' AS fixed FROM lineitem)""")
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    """Codes from the document stay, automatic ones are numbered afresh per order."""
    from pyspark.sql import Window

    fixed = F.col("l_returnflag") == "R"
    n = F.sum(F.when(fixed, 0).otherwise(1)).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    code = F.when(fixed, F.concat(F.lit("DOC-"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("REQ-"), F.lpad(n.cast("string"), 3, "0")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a table: one row for each line number."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_quantity").alias("l_quantity"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END AS a, CASE WHEN l_linenumber % 2 = 1 THEN l_linestatus ELSE '' END AS b FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)),
f AS (SELECT l_orderkey, l_linenumber, b, coalesce(last_value(nullif(a, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), '') AS a FROM g),
c AS (SELECT *, CASE WHEN a IS DISTINCT FROM lag(a) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) THEN 1 ELSE 0 END AS n FROM f),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM c)
SELECT l_orderkey, l_linenumber, a AS top, coalesce(last_value(nullif(b, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber), '') AS mid FROM r""")
def fill_down(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).otherwise("").alias("top"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linestatus")).otherwise("").alias("mid"))
    return order.fill_down(g, ["l_orderkey"], "l_linenumber", ["top", "mid"]).select("l_orderkey", "l_linenumber", "top", "mid")


@query("""WITH r AS (SELECT conv_id, turn, turn // 4 AS tab, (turn // 2) * CASE WHEN turn > 6 THEN 3 ELSE 1 END AS page, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS top, CASE WHEN turn % 3 = 1 THEN role ELSE '' END AS mid FROM conversations),
b AS (SELECT *, CASE WHEN coalesce(tab = lag(tab) OVER w OR page - lag(page) OVER w BETWEEN 0 AND 1, false) THEN 0 ELSE 1 END AS br FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(br) OVER (PARTITION BY conv_id ORDER BY turn) AS stretch FROM b),
n AS (SELECT *, sum(CASE WHEN top <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, stretch ORDER BY turn) AS blk FROM s)
SELECT conv_id, turn, coalesce(last_value(nullif(top, '') IGNORE NULLS) OVER (PARTITION BY conv_id, stretch ORDER BY turn), '') AS top,
 coalesce(last_value(nullif(mid, '') IGNORE NULLS) OVER (PARTITION BY conv_id, stretch, blk ORDER BY turn), '') AS mid FROM n""")
def carry_gate(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(turn / 4).alias("tab"), (F.floor(turn / 2) * F.when(turn > 6, 3).otherwise(1)).alias("page"), F.when(turn % 2 == 0, F.col("role")).otherwise("").alias("top"), F.when(turn % 3 == 1, F.col("role")).otherwise("").alias("mid"))
    return order.carry_gated(r, ["conv_id"], "turn", "tab", "page", "top", "mid").select("conv_id", "turn", "top", "mid")


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN substring(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '미분류') AS category FROM conversations""")
def carry_category(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return order.carry(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.substring("text", 1, 20)), "category", "미분류").select("conv_id", "turn", "category")


@query("""WITH r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events))
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first_event, count(*) AS n FROM r GROUP BY user_id, run""")
def run_groups(spark: SparkSession, sf: str) -> DataFrame:
    r = order.islands(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return r.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.min("event_type").alias("event_type"), F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT conv_id, turn, text, CASE WHEN turn <> min(turn) OVER (PARTITION BY conv_id) AND role = 'assistant' THEN 0 ELSE 1 END AS s FROM conversations),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM f)
SELECT conv_id, min(turn) AS turn, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_rows FROM g GROUP BY conv_id, p""")
def wrapped_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return order.joined_rows(c, ["conv_id"], "turn", "text", F.col("role") == "assistant")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN 1 ELSE 0 END AS header,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders),
t AS (SELECT *, sum(header) OVER (PARTITION BY o_custkey ORDER BY seq) AS tab FROM h)
SELECT o_custkey, CAST(tab AS BIGINT) AS tab, min(o_orderpriority) AS header, count(*) AS n_rows, min(seq) AS first_row, max(seq) AS last_row FROM t GROUP BY o_custkey, tab""")
def fragment_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of a table without a new header belong to the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.row_number().over(w).cast("long").alias("seq"))
    merged = order.islands(rows, ["o_custkey"], "seq", "o_orderpriority", "tab")
    return merged.groupBy("o_custkey", F.col("tab").cast("long").alias("tab")).agg(F.min("o_orderpriority").alias("header"), F.count("*").alias("n_rows"), F.min("seq").alias("first_row"), F.max("seq").alias("last_row"))


@query("""SELECT user_id, event_id, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS page FROM events""")
def page_clamp(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").alias("raw"))
    return order.clamped(e, ["user_id"], "event_id", "raw", "page").select("user_id", "event_id", "page")


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS page FROM events)
SELECT user_id, event_id, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS page FROM p""")
def page_interp(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.floor("value")).alias("page"))
    return order.interpolated(e, ["user_id"], "event_id", "page")


@query("""SELECT user_id, event_id, CASE WHEN a = b AND v <> a THEN a ELSE v END AS page FROM (SELECT user_id, event_id, v, lag(v) OVER w AS a, lead(v) OVER w AS b
FROM (SELECT user_id, event_id, CAST(floor(value / 25) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def page_spike(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.col("value") / 25).alias("page"))
    return order.spikes_removed(e, ["user_id"], "event_id", "page")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 + l_linenumber % 3 AS level FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, CAST(a.level AS INTEGER) AS level, min(b.l_linenumber) AS end_line FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber AND b.level <= a.level
GROUP BY a.l_orderkey, a.l_linenumber, a.level""")
def section_span(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid(spark, sf).select("l_orderkey", "l_linenumber", (F.lit(1) + F.col("l_linenumber") % 3).cast("int").alias("level"))
    return order.spans(rows, ["l_orderkey"], "l_linenumber", "level", "end_line")
