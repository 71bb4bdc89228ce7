"""Lexical and vector search: BM25 and cosine top-k, hybrid union, grading of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx

K1, B = 1.5, 0.75


def bm25(corpus: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score): every pair with a common term. score = sum over terms of idf * tf / (tf + k1 (1 - b + b dl / avgdl)).

    Only terms that queries have are kept of the corpus before anything is shuffled; the query vocabulary joins as the
    smaller side, broadcast by the planner if its size allows. Scores are rounded to 6 digits.
    """
    q = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tx.words(F.col(query_text)))).alias("term"))
    vocabulary = q.select("term").distinct()
    docs = corpus.select(F.col(doc_id).alias("doc"), tx.words(F.col(doc_text)).alias("ws"))
    # Documents without words do not count; a filter on them would split every text once more.
    n_words = F.nullif(F.size("ws"), F.lit(0))
    stats = docs.agg(F.count(n_words).alias("n_docs"), F.avg(n_words).alias("avgdl"))
    hits = docs.select("doc", F.size("ws").alias("dl"), F.explode("ws").alias("term")).join(vocabulary, "term", "left_semi")
    tf = hits.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("doc", "term", weight.alias("w"))  # stats is one row
    return q.join(weighted, "term").groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score"))


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best of each group, from 1; ties by the tie column.

    First within (group, part), a part being a share of the candidates, then among the parts' winners: a group of any size
    is cut down where it lies.
    """
    order = [F.col(score).desc(), F.col(tie)]
    part = F.pmod(F.xxhash64(tie), F.lit(64))
    first = scored.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))).filter(F.col("__r") <= k)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= k).drop("__part", "__r")


def cosine_scores(vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str) -> DataFrame:
    """(query, doc, score): every query against every vector, exact. The query set is a stated block and is broadcast by the planner."""
    q = queries.select(F.col(query_id).alias("query"), F.col(query_vec).alias("qv"))
    v = vectors.select(F.col(vec_id).alias("doc"), F.col(vec).alias("v"))
    return v.crossJoin(q).filter(F.col("query") != F.col("doc")).select("query", "doc", F.round(tx.cosine(F.col("v"), F.col("qv")), 6).alias("score"))


def term_cosine(corpus: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str) -> DataFrame:
    """(query, doc, score): exact cosine of the word counts of whole texts, for every pair with a common word."""

    def vectors(df: DataFrame, id_col: str, text: str, name: str) -> tuple[DataFrame, DataFrame]:
        tf = df.select(F.col(id_col).alias(name), F.explode(tx.words(F.col(text))).alias("term")).groupBy(name, "term").agg(F.count("*").alias(f"tf_{name}"))
        return tf, tf.groupBy(name).agg(F.sqrt(F.sum(F.col(f"tf_{name}") * F.col(f"tf_{name}"))).alias(f"norm_{name}"))

    (q, q_norm), (d, d_norm) = vectors(queries, query_id, query_text, "query"), vectors(corpus, doc_id, doc_text, "doc")
    dots = q.join(d, "term").groupBy("query", "doc").agg(F.sum(F.col("tf_query") * F.col("tf_doc")).alias("dot"))
    return dots.join(q_norm, "query").join(d_norm, "doc").select("query", "doc", F.round(F.col("dot") / (F.col("norm_query") * F.col("norm_doc")), 6).alias("score"))


def hybrid(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Union of two ranked lists (query, doc, rank): the first list's entries come first, a doc counts once, at most `most` stay."""
    both = first.select("query", "doc", F.col("rank").alias("first_rank"), F.lit(None).cast("int").alias("second_rank")).unionByName(second.select("query", "doc", F.lit(None).cast("int").alias("first_rank"), F.col("rank").alias("second_rank")))
    merged = both.groupBy("query", "doc").agg(F.min("first_rank").alias("first_rank"), F.min("second_rank").alias("second_rank"))
    order = [F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last(), F.col("doc")]
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)


def fallback_grade(top: Column, enough: float = 8.0) -> Column:
    """No hit: X. A top score of at least `enough`: △. Else X."""
    return F.when(F.coalesce(top, F.lit(0.0)) >= enough, "△").otherwise("X")


def adopted(hits: DataFrame, grade: str) -> DataFrame:
    """Evidence that counts: all for O, the best for △, none for X."""
    return hits.withColumn("adopted", (F.col(grade) == "O") | ((F.col(grade) == "△") & (F.col("rank") == 1)))


def gap_score(phrase: Column, vocabulary: list[str], query: Column) -> Column:
    """Known word +3, technical mark +2, several words and 6 characters +1, words of the query +1."""
    low = F.lower(phrase)
    known = F.exists(F.array(*(F.lit(v.lower()) for v in vocabulary)), lambda v: low.contains(v)) if vocabulary else F.lit(False)
    shared = F.size(F.array_intersect(tx.words(phrase), tx.words(query))) > 0
    return F.when(known, 3).otherwise(0) + F.when(phrase.rlike("[A-Z]{2,}|[0-9]"), 2).otherwise(0) + F.when(phrase.contains(" ") & (F.length(phrase) >= 6), 1).otherwise(0) + F.when(shared, 1).otherwise(0)


def coverage(gold: DataFrame, outputs: DataFrame, gold_id: str, gold_text: str, out_text: str, n: int = 6, least: float = 0.6) -> DataFrame:
    """(gold_id, share, covered): the largest share of a gold item's n-grams (of signatures) that one output has.

    Output grams are kept only if some gold item has them, before they are shuffled. Grams go as hashes of 64 bits; grams of
    an output are made distinct only after that.
    """
    hashed = lambda t, make: F.transform(make(t, n), lambda x: F.xxhash64(x))
    g = gold.select(F.col(gold_id).alias("gold"), F.explode(F.array_distinct(hashed(tx.sig(F.col(gold_text)), tx.runs))).alias("gram"))
    sizes = g.groupBy("gold").agg(F.count("*").alias("n"))
    texts = outputs.select(tx.sig(F.col(out_text)).alias("s")).withColumn("o", F.xxhash64("s"))  # equal outputs are one
    o = texts.select("o", F.explode(hashed(F.col("s"), tx.runs)).alias("gram")).join(g.select("gram").distinct(), "gram", "left_semi").distinct()
    shared = g.join(o, "gram").groupBy("gold", "o").agg(F.count("*").alias("m")).groupBy("gold").agg(F.max("m").alias("m"))
    found = sizes.join(shared, "gold", "left").withColumn("share", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 6))
    return found.select(F.col("gold").alias(gold_id), "share", (F.col("share") >= least).alias("covered"))
