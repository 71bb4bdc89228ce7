"""Distinct rows, duplicate groups, components, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import dedup
from docweave.plans.registry import query, table


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') ORDER BY doc_id) AS n, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM documents) WHERE n = 1 AND s <> ''""")
def distinct_sig(spark: SparkSession, sf: str) -> DataFrame:
    """First document of each signature; compared by a 256-bit digest, so that texts are not shuffled."""
    d = dedup.signature_digests(table(spark, sf, "documents"), "doc_id", "text")
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS n_details FROM l WHERE length(trim(x)) >= 10 GROUP BY doc_id""")
def distinct_details(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: F.length(F.trim(x)) >= 10)
    return table(spark, sf, "documents").select("doc_id", F.size(kept).cast("long").alias("n_details")).filter("n_details > 0")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_dup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "n")


@query("""SELECT p_name, p_type, min(p_partkey) AS canonical, count(*) AS n FROM part GROUP BY p_name, p_type HAVING count(*) > 1""")
def sku_dup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("canonical"), F.count("*").alias("n")).filter("n > 1")


def representatives(spark: SparkSession, sf: str) -> DataFrame:
    """One document per distinct text and language, with its words."""
    d = table(spark, sf, "documents")
    first = d.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    return d.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", tx.words(F.col("text"), 1).alias("ws"))


def fives(ws: str):
    """Hashes of the runs of five words; a shorter text is one run, an empty one has none."""
    runs = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 5), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(5))))
    w = F.col(ws)
    return F.when(F.size(w) >= 5, tx.bound(w, runs)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


NEAR_SQL = r"""d AS (SELECT doc_id, lang, ws FROM (SELECT min(doc_id) AS doc_id, lang, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}_]{1,}') AS ws FROM documents GROUP BY lang, text)),
s AS (SELECT DISTINCT doc_id, lang, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.lang = b.lang AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.lang, a.doc_id, b.doc_id),
p AS (SELECT lang, a, b, round(m / (x.n + y.n - m), 6) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE round(m / (x.n + y.n - m), 6) >= 0.8)"""


@query(f"WITH {NEAR_SQL} SELECT lang, a, b, similarity FROM p")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct texts of a language whose five-word runs have a Jaccard of 0.8 or more; copies are represented once."""
    pairs = dedup.shingle_pairs(representatives(spark, sf), "doc_id", "lang", fives("ws"))
    return pairs.withColumnRenamed("block", "lang")


@query(f"""WITH RECURSIVE {NEAR_SQL}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT node AS doc_id, min(root) AS component FROM r GROUP BY node""")
def dup_components(spark: SparkSession, sf: str) -> DataFrame:
    pairs = dedup.shingle_pairs(representatives(spark, sf), "doc_id", "lang", fives("ws"))
    return dedup.components(pairs.select("a", "b")).select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


@query()
def dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its class, over copies and pairs of 0.8 or more in any language, and the other documents that it equals or is paired with."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = d.join(first.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", F.lit("").alias("block"), tx.words(F.col("text"), 1).alias("ws"))
    pairs = dedup.written(dedup.shingle_pairs(reps, "doc_id", "block", fives("ws")).select("a", "b"))
    sizes = first.select(F.col("rep").alias("b"), "copies")
    linked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("linked"))
    roots = dedup.components(pairs).select(F.col("node").alias("rep"), "root")
    known = first.join(linked, "rep", "left").join(roots, "rep", "left")
    classes = known.select("digest", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return d.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", "n_links")


@query("""WITH l AS (SELECT label, count(*) AS n FROM (SELECT string_split(p_type, ' ')[1] AS label FROM part UNION ALL SELECT p_type FROM part) GROUP BY label),
m AS (SELECT l.label, l.n, coalesce((SELECT x.label FROM l x WHERE contains(x.label, l.label) AND length(x.label) > length(l.label) ORDER BY length(x.label), x.label LIMIT 1), l.label) AS merged FROM l) SELECT label, n, merged FROM m""")
def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    labels = p.select(F.get(F.split("p_type", " "), F.lit(0)).alias("label")).unionByName(p.select(F.col("p_type").alias("label"))).groupBy("label").agg(F.count("*").alias("n"))
    return dedup.substring_merge(labels, "label", "n")


@query("""WITH l AS (SELECT replace(p_brand, '#', '') AS label, count(*) AS n FROM part GROUP BY 1), x AS (SELECT a.label, a.n, b.label AS other, CASE WHEN contains(a.label, b.label) OR contains(b.label, a.label) THEN 0.9 ELSE list_max(list_transform(range(0, least(length(a.label), length(b.label)) + 1), lambda i: CASE WHEN substring(a.label, 1, i) = substring(b.label, 1, i) THEN CASE WHEN i >= 3 THEN i ELSE 0 END ELSE 0 END)) / greatest(length(a.label), length(b.label)) END AS s FROM l a JOIN l b ON a.label <> b.label)
SELECT label, n, other, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, other) AS k FROM x) WHERE k = 1""")
def label_absorb(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand label the most similar other one: containment 0.9, else the shared beginning. A dictionary against itself."""
    l = table(spark, sf, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    o = l.select(F.col("label").alias("other"))
    x = l.join(o, F.col("label") != F.col("other")).withColumn("similarity", F.round(tx.label_similarity(F.col("label"), F.col("other")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "other")
    return x.withColumn("k", F.row_number().over(w)).filter("k = 1").select("label", "n", "other", "similarity")


@query("""SELECT tab, CASE WHEN n = 1 THEN cut ELSE substring(cut, 1, 31 - length('_' || n)) || '_' || n END AS sheet FROM (SELECT tab, substring(tab, 1, 12) AS cut, row_number() OVER (PARTITION BY substring(tab, 1, 12) ORDER BY tab) AS n FROM (SELECT DISTINCT p_name AS tab FROM part))""")
def sheet_names(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.substring("tab", 1, 12)
    t = table(spark, sf, "part").select(F.col("p_name").alias("tab")).distinct().withColumn("n", F.row_number().over(Window.partitionBy(cut).orderBy("tab")))
    return t.select("tab", F.when(F.col("n") == 1, cut).otherwise(F.concat(cut, F.lit("_"), F.col("n").cast("string"))).alias("sheet"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source AND a.doc_id < b.doc_id)""")
def merged_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that no earlier row of another source already has: the earliest row and source of each text decide."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h", "source").agg(F.min("doc_id").alias("first"))
    w = Window.partitionBy("h").orderBy("first")
    two = first.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("h").agg(F.min_by("source", "k").alias("s1"), F.min("first").alias("f1"), F.max(F.when(F.col("k") == 2, F.col("first"))).alias("f2"))
    other = F.when(F.col("source") == F.col("s1"), F.col("f2")).otherwise(F.col("f1"))
    return d.join(two, "h").filter(other.isNull() | (F.col("doc_id") < other)).select("doc_id")
