"""Pages: blocks, plain text, counts, and form pivots on derived grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import html
from docweave.plans.order_plans import grid
from docweave.plans.registry import query, table


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<t[dh][ >/]')) AS INTEGER) AS n_cells, CAST(len(regexp_extract_all(html, '(?i)<p[ >/]')) AS INTEGER) AS n_paragraphs FROM pages""")
def html_counts(spark: SparkSession, sf: str) -> DataFrame:
    cells, paragraphs = html.feature_counts(F.col("html"))
    return table(spark, sf, "pages").select("page_id", cells.cast("int").alias("n_cells"), paragraphs.cast("int").alias("n_paragraphs"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.plain_text(F.col("html")).alias("text"))


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.blocks(table(spark, sf, "pages"))


@query()
def html_compact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.compact(F.col("html")).alias("html"))


@query("""SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def form_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Label/value rows of a form back to one row per block."""
    l = grid(spark, sf)
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "quantity": F.col("l_quantity").cast("long").cast("string")}.items()))
    long = l.select("l_orderkey", "l_linenumber", F.inline(pairs))
    return long.groupBy("l_orderkey", "l_linenumber").agg(*(F.max(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in ("flag", "status", "quantity")))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS first_page FROM h GROUP BY host""")
def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
