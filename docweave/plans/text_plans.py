"""Text: keys, predicates, titles, keywords, splits, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import split
from docweave.plans.registry import query, table

S = r"[ \t\n\x0B\f\r]+"


@query(rf"""SELECT doc_id, trim(regexp_replace(text, '{S}', ' ', 'g')) AS norm, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS sig FROM documents""")
def norm_sig(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.norm(F.col("text")).alias("norm"), tx.sig(F.col("text")).alias("sig"))


@query(r"""SELECT p_partkey, replace(p_brand, '#', '-') AS code, length(replace(p_brand, '#', '-')) <= 12 AND regexp_matches(replace(p_brand, '#', '-'), '^[A-Za-z0-9가-힣]{0,6}[_\-/.]?[0-9]{1,4}$') AS is_code,
  length(p_name) > 0 AND length(p_name) <= 48 AND NOT regexp_matches(p_name, '[.!?]$') AS is_label FROM part""")
def label_predicates(spark: SparkSession, sf: str) -> DataFrame:
    code = F.replace("p_brand", F.lit("#"), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", code.alias("code"), tx.looks_like_code(code).alias("is_code"), tx.valid_label(F.col("p_name")).alias("is_label"))


LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]'))"


@query(f"""SELECT doc_id, substring(trim({LINES}[1]), 1, 120) AS title FROM documents""")
def title_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.first_line(F.col("text")).alias("title"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM documents),
u AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w) GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u)
SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 8 GROUP BY doc_id""")
def keywords8(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))
    return d.filter("keywords <> ''")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '.  ' || chr(13)), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.replace("text", F.lit("."), F.lit(".  \r"))
    return table(spark, sf, "documents").select("doc_id", tx.normalized_lines(raw).alias("text"))


#: Every third line is given its number as a mark.
MARKED_SQL = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 THEN CAST((i + 2) // 3 AS VARCHAR) || ') ' || x ELSE x END), chr(10))"""


def marked(text: str = "text"):
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(((i + 3) / 3).cast("int").cast("string"), F.lit(") "), x)).otherwise(x))
    return F.array_join(lines, "\n")


@query(f"""WITH m AS (SELECT doc_id, {MARKED_SQL} AS text FROM documents),
l AS (SELECT doc_id, {LINES} AS ls FROM m), e AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM l),
f AS (SELECT *, CASE WHEN i = 1 OR regexp_matches(x, '^[ \\t]*([①-⑳]|\\([0-9]{{1,3}}\\)|[0-9]{{1,3}}[.)]|[가-하][.)])[ \\t]*') THEN 1 ELSE 0 END AS s FROM e),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS atom, string_agg(x, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id, n""")
def marker_atoms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", marked().alias("cell"))
    return d.select("doc_id", F.posexplode(tx.marker_pieces(F.col("cell"))).alias("atom", "text"))


@query(f"""WITH l AS (SELECT doc_id, list_transform({LINES}, lambda x: trim(x)) AS ls FROM (SELECT doc_id, replace(text, ', ', chr(10)) AS text FROM documents)),
e AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM l), p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e),
f AS (SELECT *, CASE WHEN i = 1 OR regexp_matches(x, '^[ \\t]*([①-⑳]|\\([0-9]{{1,3}}\\)|[0-9]{{1,3}}[.)]|[가-하][.)])[ \\t]*') OR regexp_matches(x, '^[ \\t]*([-•·○●▪◦□■])[ \\t]+') OR regexp_matches(before, '[.!?:;,]["'')\\]]*[ \\t]*$') THEN 1 ELSE 0 END AS s FROM p),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f), j AS (SELECT doc_id, n, string_agg(x, ' ' ORDER BY i) AS x FROM g GROUP BY doc_id, n)
SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS text FROM j GROUP BY doc_id""")
def line_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\n")).alias("t"))
    return d.select("doc_id", tx.joined_lines(F.col("t")).alias("text")).filter("text <> ''")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(replace(text, ', ', ' - '), chr(10))) AS l FROM documents),
p AS (SELECT doc_id, trim(unnest(string_split(l, ' - '))) AS piece FROM c)
SELECT doc_id, piece, count(*) AS n FROM p WHERE piece <> '' GROUP BY doc_id, piece""")
def sentence_atoms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(tx.bullet_pieces(F.replace("text", F.lit(", "), F.lit(" - ")))).alias("piece"))
    return d.groupBy("doc_id", "piece").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1000) / 800.0), 0) AS BIGINT) + 1)) AS no FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(no * 800 AS INTEGER) AS start, substring(text, CAST(no * 800 + 1 AS BIGINT), 1000) AS text FROM k""")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.inline(tx.fixed_chunks(F.col("text"))))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return split.recursive_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""WITH g AS (SELECT p_partkey, p_name, p_type, list_distinct(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substring(p_name, i, 3))) AS a,
  list_distinct(list_transform(range(1, greatest(length(p_type) - 1, 1)), lambda i: substring(p_type, i, 3))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard3 FROM g WHERE length(p_name) >= 3 AND length(p_type) >= 3""")
def gram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("length(p_name) >= 3 AND length(p_type) >= 3")
    return p.select("p_partkey", F.round(tx.jaccard(tx.grams(F.col("p_name"), 3), tx.grams(F.col("p_type"), 3)), 6).alias("jaccard3"))


@query(r"""SELECT doc_id, length(trim(t)) < 3 OR regexp_matches(t, '^[-–( ]*[0-9]{1,4}[-–) ]*$') OR regexp_matches(t, '^[0-9]{4}[./-][0-9]{1,2}([./-][0-9]{1,2})?\.?$') OR regexp_matches(t, '[.·…]{4,} ?[0-9]{1,4}$') AS junk
FROM (SELECT doc_id, trim(regexp_replace(coalesce(string_split(text, '.')[1], ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)""")
def junk_details(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.junk_detail(F.get(F.split("text", r"\."), F.lit(0))).alias("junk"))
