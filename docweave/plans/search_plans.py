"""Search: BM25, cosine, hybrid, grades, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import nearest, search
from docweave.plans.registry import query, table

BM25_SQL = r"""q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark),
d AS (SELECT doc_id AS doc, ws, len(ws) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM documents) WHERE len(ws) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, dl, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term), st),
sc AS (SELECT query, doc, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY query, doc)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@query(f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc), b AS (SELECT query, max(score) AS top FROM sc GROUP BY query)
SELECT query AS item_id, doc AS doc_id, score, CAST(rank AS INTEGER) AS rank, CASE WHEN top >= 8.0 THEN '△' ELSE 'X' END AS grade FROM r JOIN b USING (query) WHERE rank <= 10""")
def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = search.top_k(scores(spark, sf), "query", "score", "doc", 10)
    from pyspark.sql import Window

    best = F.max("score").over(Window.partitionBy("query"))
    return top.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank", search.fallback_grade(best).alias("grade"))


@query(f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)
SELECT query AS item_id, doc AS doc_id, score FROM r JOIN documents ON doc = doc_id WHERE rank <= 10 AND score > 0 AND source IN ('src0', 'src1', 'src2', 'src3')""")
def bm25_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    """The source filter holds after the ten best are chosen, so fewer may be left."""
    top = search.top_k(scores(spark, sf), "query", "score", "doc", 10).filter("score > 0")
    sources = table(spark, sf, "documents").select("doc_id", "source").filter(F.col("source").isin("src0", "src1", "src2", "src3"))
    return top.join(sources, F.col("doc") == F.col("doc_id")).select(F.col("query").alias("item_id"), "doc_id", "score")


COSINE_SQL = """q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT query, vec_id AS doc, label, round(coalesce(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 0), 6) AS score FROM embeddings, q WHERE vec_id <> query)"""


def vector_scores(spark: SparkSession, sf: str, vectors: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    # Searches take every 50th row as a query, against all rows.
    return search.cosine_scores(vectors if vectors is not None else e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding")


@query(f"""WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank, 1 - (1 - score) / 2 AS closeness FROM r WHERE rank <= 5""")
def cosine_top5(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    top = nearest.cosine_top(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return top.withColumn("closeness", 1 - (1 - F.col("score")) / 2)


@query(f"""WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc WHERE label IN (0, 1, 2))
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vector_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """The label filter holds before the best are chosen."""
    return search.top_k(vector_scores(spark, sf, table(spark, sf, "embeddings").filter(F.col("label").isin(0, 1, 2))), "query", "score", "doc", 5)


@query(f"""WITH {BM25_SQL}, a AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r1 FROM sc),
t AS (SELECT query, doc, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS score FROM (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(substring(text, 1, 200)), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS x FROM benchmark),
 (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(substring(text, 1, 200)), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS y FROM documents) WHERE len(list_intersect(x, y)) > 0),
b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r2 FROM t),
u AS (SELECT query, doc, min(r1) AS r1, min(r2) AS r2 FROM (SELECT query, doc, r1, NULL AS r2 FROM a WHERE r1 <= 5 UNION ALL SELECT query, doc, NULL, r2 FROM b WHERE r2 <= 5) GROUP BY query, doc),
f AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY r1 NULLS LAST, r2 NULLS LAST, doc) AS rank FROM u)
SELECT query AS item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10""")
def hybrid_union(spark: SparkSession, sf: str) -> DataFrame:
    """Best by BM25, then best by the word overlap of the openings, without score fusion."""
    first = search.top_k(scores(spark, sf), "query", "score", "doc", 5)
    start = lambda c: F.array_distinct(tx.words(F.substring(c, 1, 200)))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), start(F.col("text")).alias("x"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), start(F.col("text")).alias("y"))
    both = q.select("query", F.size("x").alias("nx"), F.explode("x").alias("w")).join(d.select("doc", F.size("y").alias("ny"), F.explode("y").alias("w")), "w").groupBy("query", "doc", "nx", "ny").agg(F.count("*").alias("m"))
    overlap = both.select("query", "doc", F.round(F.col("m") / (F.col("nx") + F.col("ny") - F.col("m")), 6).alias("score"))
    second = search.top_k(overlap, "query", "score", "doc", 5)
    return search.hybrid(first, second, 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank")


@query()
def hybrid_whole(spark: SparkSession, sf: str) -> DataFrame:
    """D04 over whole texts: best by the cosine of word counts first, then best by BM25, without score fusion."""
    first = search.term_cosine(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")
    both = search.hybrid(search.top_k(first, "query", "score", "doc", 5), search.top_k(scores(spark, sf), "query", "score", "doc", 5), 10)
    return both.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank")


GRAMS6 = "CASE WHEN length(s) >= 6 THEN list_distinct(list_transform(range(1, length(s) - 4), lambda i: substring(s, i, 6))) WHEN length(s) > 0 THEN [s] ELSE [] END"


@query(f"""WITH g AS (SELECT item_id, unnest({GRAMS6}) AS gram FROM (SELECT item_id, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
o AS (SELECT r, unnest({GRAMS6}) AS gram FROM (SELECT row_number() OVER () AS r, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM documents)),
m AS (SELECT item_id, max(m) AS m FROM (SELECT item_id, r, count(*) AS m FROM g JOIN o USING (gram) GROUP BY item_id, r) GROUP BY item_id)
SELECT item_id, round(coalesce(m, 0) / n, 6) AS share, round(coalesce(m, 0) / n, 6) >= 0.6 AS covered FROM n LEFT JOIN m USING (item_id)""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return search.coverage(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "text")


@query("""SELECT event_id, CASE WHEN (value / 25 + (event_id % 5) + (user_id % 4) + 3) / 4 <= 2.2 THEN 'O' WHEN (value / 25 + (event_id % 5) + (user_id % 4) + 3) / 4 <= 3.5 THEN '△' ELSE 'X' END AS mark FROM events""")
def grade_mean(spark: SparkSession, sf: str) -> DataFrame:
    mean = (F.col("value") / 25 + F.col("event_id") % 5 + F.col("user_id") % 4 + 3) / 4
    return table(spark, sf, "events").select("event_id", tx.judgement(mean).alias("mark"))


@query(r"""SELECT p_partkey, CAST(CASE WHEN lower(p_name) LIKE '%steel%' OR lower(p_name) LIKE '%brass%' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(p_name, '[A-Z]{2,}|[0-9]') THEN 2 ELSE 0 END + CASE WHEN p_name LIKE '% %' AND length(p_name) >= 6 THEN 1 ELSE 0 END
 + CASE WHEN len(list_intersect(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}'), regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]{2,}'))) > 0 THEN 1 ELSE 0 END AS INTEGER) AS score FROM part""")
def gap_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", search.gap_score(F.col("p_name"), ["steel", "brass"], F.col("p_type")).alias("score"))
