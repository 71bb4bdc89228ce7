"""Reports and small rules: gaps, audits, routing, runs, preambles, delimiters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import order, search
from docweave.plans.registry import query, table

SCORE = r"""CASE WHEN lower(p_name) LIKE '%steel%' OR lower(p_name) LIKE '%brass%' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(p_name, '[A-Z]{2,}|[0-9]') THEN 2 ELSE 0 END + CASE WHEN p_name LIKE '% %' AND length(p_name) >= 6 THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}'), regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]{2,}'))) > 0 THEN 1 ELSE 0 END"""


@query(f"""WITH s AS (SELECT p_brand, p_name, max({SCORE}) AS score FROM part GROUP BY p_brand, p_name), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, length(p_name), p_name) AS n FROM s WHERE score >= 1)
SELECT p_brand, p_name, CAST(score AS INTEGER) AS score FROM r WHERE n <= 2""")
def gap_top2(spark: SparkSession, sf: str) -> DataFrame:
    """The two best distinct phrases per group: by score, then the shorter one."""
    p = table(spark, sf, "part")
    s = p.groupBy("p_brand", "p_name").agg(F.max(search.gap_score(F.col("p_name"), ["steel", "brass"], F.col("p_type"))).alias("score")).filter("score >= 1")
    w = Window.partitionBy("p_brand").orderBy(F.desc("score"), F.length("p_name"), "p_name")
    return s.withColumn("n", F.row_number().over(w)).filter("n <= 2").select("p_brand", "p_name", "score")


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AS selected, CASE WHEN l.doc_id IS NULL THEN 'not reviewed' WHEN l.quality = 1 THEN '' ELSE 'low quality' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def audit_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate is selected or has a reason."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"))
    d = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.col("q") == 1, F.lit(False)).alias("selected"), F.when(F.col("q").isNull(), "not reviewed").when(F.col("q") == 1, "").otherwise("low quality").alias("reason"))


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) SELECT p_partkey, CASE WHEN n >= 35 THEN p_type ELSE string_split(p_type, ' ')[1] END AS tab FROM part JOIN c USING (p_type)""")
def size_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Large sections are tabs of their own, small ones go to their chapter."""
    p = table(spark, sf, "part")
    sizes = p.groupBy(F.col("p_type").alias("t")).agg(F.count("*").alias("n"))
    tab = F.when(F.col("n") >= 35, F.col("p_type")).otherwise(F.get(F.split("p_type", " "), F.lit(0)))
    return p.join(sizes, F.col("p_type") == F.col("t")).select("p_partkey", tab.alias("tab"))


@query("""WITH r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events))
SELECT event_id FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id, run) AS n FROM r) WHERE n < 3""")
def run_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of three or more equal neighbours are dropped, as contents lists are."""
    r = order.islands(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return r.withColumn("n", F.count("*").over(Window.partitionBy("user_id", "run"))).filter("n < 3").select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events) WHERE new""")
def neighbour_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key equals that of the row before are dropped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").withColumn("same", F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) & (F.row_number().over(w) > 1)).filter("NOT same").select("event_id")


@query("""WITH f AS (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_one FROM conversations) SELECT conv_id, turn FROM f WHERE seen = 1 OR has_one = 0""")
def preamble_drop(spark: SparkSession, sf: str) -> DataFrame:
    """What comes before the first heading is dropped; all stays where there is none."""
    head = F.when(F.col("role") == "assistant", 1).otherwise(0)
    w = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").withColumn("seen", F.max(head).over(w.orderBy("turn"))).withColumn("has_one", F.max(head).over(w))
    return c.filter("seen = 1 OR has_one = 0").select("conv_id", "turn")


@query("""WITH p AS (SELECT item_id, unnest(string_split(text, '. ')) AS piece, unnest(range(0, len(string_split(text, '. ')))) AS i FROM benchmark) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS no, '. ' || trim(piece) AS piece FROM p WHERE trim(piece) <> ''""")
def delimiter_split(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces between a user's delimiter, each with the delimiter before it."""
    pieces = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(F.transform(pieces, lambda x: F.concat(F.lit(". "), x))).alias("no", "piece"))


@query("""WITH m AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'X' WHEN quality = 1 THEN 'O' ELSE '△' END AS mark FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (mark = 'O') AS n_o, count(*) FILTER (mark = '△') AS n_tri, count(*) FILTER (mark = 'X') AS n_x, coalesce(array_to_string((list_sort(list(doc_id) FILTER (mark = 'X')))[1:8], ','), '') AS first_x FROM m GROUP BY source""")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Grades per category, with the first eight of the worst; those are found by a running number, not by a list of all."""
    mark = F.when(F.col("toxic") == 1, "X").when(F.col("quality") == 1, "O").otherwise("△")
    m = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", mark.alias("mark"))
    n = m.groupBy("source").agg(*(F.count_if(F.col("mark") == k).alias(c) for k, c in (("O", "n_o"), ("△", "n_tri"), ("X", "n_x"))))
    few = order.numbered(m.filter("mark = 'X'"), ["source"], "doc_id").filter("n <= 8").groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return n.join(few, F.col("source") == F.col("s"), "left").select("source", "n_o", "n_tri", "n_x", F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("first_x"))


@query("""WITH g AS (SELECT label, unnest(list_distinct(list_transform(range(1, length(label) - 1), lambda i: substring(label, i, 3)))) AS gram FROM (SELECT DISTINCT p_name AS label FROM part)), n AS (SELECT label, count(*) AS n FROM g GROUP BY label),
p AS (SELECT a.label AS a, b.label AS b, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.label < b.label GROUP BY 1, 2)
SELECT a, b, round(m / (x.n + y.n - m), 6) AS similarity FROM p JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE contains(a, b) OR contains(b, a) OR round(m / (x.n + y.n - m), 6) >= 0.3""")
def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that contain one another, or share three tenths of their 3-grams; joined on grams."""
    g = table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct().withColumn("g", tx.grams(F.col("label"), 3))
    e = g.select("label", F.size("g").alias("n"), F.explode("g").alias("gram"))
    f = e.select(F.col("label").alias("b"), F.col("n").alias("nb"), "gram")
    p = e.withColumnRenamed("label", "a").join(f, "gram").filter("a < b").groupBy("a", "b", "n", "nb").agg(F.count("*").alias("m"))
    s = F.round(F.col("m") / (F.col("n") + F.col("nb") - F.col("m")), 6)
    return p.select("a", "b", s.alias("similarity")).filter((F.col("similarity") >= 0.3) | F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'click,purchase' ELSE 'click' END AS routed FROM events""")
def source_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen sources, once each and in order, as far as they are allowed."""
    chosen = F.array(F.lit("click"), F.col("event_type"), F.lit("view"), F.col("event_type"))
    routed = F.array_distinct(F.filter(chosen, lambda s: s.isin("click", "purchase")))
    return table(spark, sf, "events").select("event_id", F.array_join(routed, ",").alias("routed"))
