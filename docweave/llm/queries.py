"""The subpackage's queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import chat_format, classifier, decontamination, html_extract, line_dedup, mixing, quality_rules, simhash, substring_dedup, token_counts
from docweave.llm.shared import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the evidence, for every document that contains a benchmark item."""
    return decontamination.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(read(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(read(spark, sf_dir, "documents"))
    base = quality_rules.rejected(F.col("fail_bits"), "base")
    verdict = ~quality_rules.rejected(F.col("fail_bits"), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict).alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy version and rule of op4: documents that the rule fails, and that it alone rejects."""
    return quality_rules.all_ablations(quality_rules.ledger(read(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each duplicate span: the document, where, and the first document that has its beginning."""
    return substring_dedup.spans(read(spark, sf_dir, "documents")).select("doc_id", "start", "end", F.col("first_id").alias("first_doc_id"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_recurring(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_chat_format, op4_quality_rules, quality_ablations, op5_mixing, op6_substring_dedup, op7_line_dedup, op8_simhash, op9_html_extract, op10_classifier)}


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM u WINDOW v AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
  length(t) - length(replace(t, '!', '')) AS n_bangs, coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest_word,
  (length(t) - length(replace(t, 'http://', ''))) // 7 + (length(t) - length(replace(t, 'https://', ''))) // 8 AS n_urls, len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*]|•)'))) AS n_bullet_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 2 * n_upper_words > n_words THEN 32 ELSE 0 END + CASE WHEN 2 * n_bangs > n_words THEN 64 ELSE 0 END + CASE WHEN longest_word > 2000 THEN 128 ELSE 0 END + CASE WHEN n_words < 5 THEN 256 ELSE 0 END
  + CASE WHEN 5 * n_urls > n_words THEN 512 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines THEN 1024 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines THEN 2048 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 255 = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""


ABLATION_SQL = (
    OP4_SQL[: OP4_SQL.index("SELECT doc_id, CAST(n_words")]
    + """, p0 AS (SELECT * FROM (VALUES ('base', 0), ('base', 1), ('v1', 0), ('v1', 1), ('v1', 2), ('v1', 3), ('v1', 4), ('v1', 5), ('v1', 6), ('v1', 7),
  ('v2', 8), ('v2', 1), ('v2', 2), ('v2', 3), ('v2', 4), ('v2', 5), ('v2', 6), ('v2', 7), ('v2', 9), ('v2', 10), ('v2', 11)) AS x(version, i)),
names AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'word_length', 'upper_case', 'exclamations', 'blob', 'no_sentence', 'urls', 'bullets', 'ellipses']) AS rule, unnest(range(0, 12)) AS i),
whole AS (SELECT version, CAST(sum(1 << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM p0 GROUP BY version)
SELECT version, rule, count(*) FILTER (fail_bits & (1 << CAST(i AS INTEGER)) <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = 1 << CAST(i AS INTEGER)) AS n_alone
FROM b, p0 JOIN whole USING (version) JOIN names USING (i) GROUP BY version, rule
"""
)


OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
e AS (SELECT k, unnest(ls) AS l, unnest(range(0, len(ls))) AS pos FROM t),
f AS (SELECT k, pos, regexp_replace(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM e),
g AS (SELECT k, pos, m, ws, len(ws) AS n, len(ws) || ' ' || array_to_string(ws[1:3], ' ') AS path FROM (SELECT *, string_split(m, ' ') AS ws FROM f) WHERE len(ws) >= 3),
p AS (SELECT path, m, any_value(ws) AS ws, count(DISTINCT k) AS docs FROM g GROUP BY path, m),
v AS (SELECT path, sum(docs) AS leaf_docs, count(*) AS leaf_lines, bool_or(docs >= 6) AS often FROM p GROUP BY path HAVING sum(docs) >= 6),
d AS (SELECT k, sum(n) AS words, sum(n) FILTER (v.often IS NOT TRUE) AS own_words,
  max({'size': strlen(m), 'at': -pos, 'm': m}) FILTER (v.often IS NOT TRUE) AS longest FROM g LEFT JOIN v USING (path) GROUP BY k),
h AS (SELECT DISTINCT g.path, g.m, d.longest.m AS own FROM g JOIN v USING (path) JOIN d USING (k) WHERE 5 * own_words >= words),
y AS (SELECT p.path, m, docs, leaf_docs, ws FROM p JOIN v USING (path) WHERE leaf_lines > 1),
u AS (SELECT path, m, docs, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM y),
q AS (SELECT path, i, word, sum(docs) AS votes FROM u WHERE i >= 3 GROUP BY path, i, word HAVING sum(docs) >= 6),
c AS (SELECT y.path, y.m, s, list(CASE WHEN u.i < 3 OR votes >= s * leaf_docs THEN u.word END ORDER BY u.i) AS shape FROM y
  CROSS JOIN (SELECT unnest([CAST(0.4 AS DOUBLE), 0.2, 0.1, 0.05, 0.02, 0.01, 0.0]) AS s) JOIN u ON u.path = y.path AND u.m = y.m LEFT JOIN q ON q.path = u.path AND q.i = u.i AND q.word = u.word GROUP BY y.path, y.m, s),
x AS (SELECT * FROM c WHERE len(list_filter(shape, lambda w: w IS NOT NULL)) >= CAST(0.6 AS DOUBLE) * len(shape)),
w AS (SELECT x.path, s, shape FROM x JOIN h ON h.path = x.path AND h.m = x.m GROUP BY x.path, s, shape HAVING count(DISTINCT own) >= 6),
r AS (SELECT m FROM h GROUP BY m HAVING count(DISTINCT own) >= 6 UNION SELECT x.m FROM x JOIN w ON x.path = w.path AND x.s = w.s AND x.shape = w.shape),
z AS (SELECT e.k, coalesce(string_agg(l, chr(10) ORDER BY e.pos) FILTER (g.k IS NULL), '') AS kept, count(*) AS n_lines, count(g.k) AS n_dropped FROM e LEFT JOIN (SELECT k, pos FROM g WHERE m IN (SELECT m FROM r)) g ON e.k = g.k AND e.pos = g.pos GROUP BY e.k)
SELECT doc_id, kept AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN z ON t.k = z.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "quality_ablations": ABLATION_SQL, "op7_line_dedup": OP7_SQL}
