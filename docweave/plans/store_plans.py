"""Files, stores, exports, streams and HTML tables: written, read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import gates, headers
from docweave.functions import text as tx
from docweave.operators import dedup, edit, html, order, tables
from docweave.plans.registry import query, table
from docweave.sources import files, sinks
from docweave.streaming import events


def place(spark: SparkSession, name: str) -> str:
    return f"{dedup.shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


@query("SELECT p_brand AS tab, p_partkey, p_name FROM part")
def sheets_by_tab(spark: SparkSession, sf: str) -> DataFrame:
    """A folder for each tab, rows in order; read again whole."""
    at = place(spark, "tabs")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("tab"), "p_partkey", "p_name")
    sinks.by_tab(rows, at, "tab", ["p_partkey"])
    return spark.read.schema(rows.schema).parquet(at)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size, unnest(CASE WHEN p_partkey % 3 = 0 THEN [NULL] WHEN p_partkey % 3 = 1 THEN ['a.png'] ELSE ['a.png', 'b.png'] END) AS image FROM part")
def fixed_export(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed columns as text, a row for each image."""
    k = F.col("p_partkey") % 3
    images = F.when(k == 1, F.array(F.lit("a.png"))).when(k == 2, F.array(F.lit("a.png"), F.lit("b.png"))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).withColumn("images", images)
    return sinks.fixed_columns(p, ["p_partkey", "p_name", "size"], "images")


@query("""WITH l AS (SELECT p_partkey, p_brand, string_split(p_type, ' ')[1:1 + p_partkey % 3] AS ls FROM part), m AS (SELECT *, max(len(ls)) OVER (PARTITION BY p_brand) AS tab_depth, (SELECT max(len(ls)) FROM l) AS n FROM l)
SELECT p_partkey, CAST(tab_depth AS INTEGER) AS tab_depth, array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(ls[i], '')), '|') AS slots FROM m""")
def level_export(spark: SparkSession, sf: str) -> DataFrame:
    """As many level columns as the deepest row has."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.slice(F.split("p_type", " "), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")).alias("ls"))
    out = sinks.level_columns(p, "p_brand", "ls")
    return out.select("p_partkey", "tab_depth", F.concat_ws("|", *(c for c in out.columns if c.startswith("level_"))).alias("slots"))


@query("SELECT p_partkey, sha256(p_name) AS digest, p_size + 1 AS p_size FROM part")
def cache_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a cache are written, the second one is read."""
    at = place(spark, "cache")
    p = table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"), F.col("p_size").cast("long").alias("p_size"))
    edit.save_version(p, at, 1, "digest")
    edit.save_version(p.withColumn("p_size", F.col("p_size") + 1), at, 2, "digest")
    return edit.load_version(spark, at, 2).select("p_partkey", "digest", "p_size")


@query("SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) AS price FROM part WHERE p_size % 2 = 0")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON lines, read again."""
    at = place(spark, "json")
    p = table(spark, sf, "part").filter("p_size % 2 = 0").select("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("price"))
    sinks.json_rows(p, at)
    return spark.read.schema(p.schema).json(at)


@query("SELECT 'text' AS kind, CAST(strlen(text) + 1 AS BIGINT) AS length, sha256(text || chr(10)) AS digest, substring(sha256(text || chr(10)), 1, 16) AS key FROM benchmark")
def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each item; kind, length, digest and cache key of each."""
    at = place(spark, "files")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(at)
    return files.documents(spark, at, "*.txt").select("kind", "length", "digest", files.cache_key(F.col("digest")).alias("key"))


@query("SELECT text || chr(10) AS text FROM benchmark")
def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Text files, each one whole."""
    at = place(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(at)
    return files.texts(spark, at).select("text")


@query("SELECT doc_id, text FROM documents")
def decoded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes as text; every third document comes in the Korean code page's own way, which for ASCII is the same."""
    return table(spark, sf, "documents").select("doc_id", files.decoded(F.encode("text", "UTF-8")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9가-힣:+#._-]{2,}'), lambda x: lower(x)), ' ') AS words FROM documents""")
def tech_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with the marks of technical names."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.tech_words(F.col("text")), " ").alias("words"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS part, p_brand, '' AS p_type FROM part""")
def masked_export(spark: SparkSession, sf: str) -> DataFrame:
    """What the mode hides is blank."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("part"), "p_brand", "p_type")
    return sinks.masked_by_mode(p, "human", ["p_type"], ["p_brand"])


@query("""WITH e AS (SELECT p_partkey, [p_brand, p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END, p_brand] AS r FROM part), u AS (SELECT p_partkey, unnest(r) AS x, unnest(range(0, 5)) AS i FROM e), d AS (SELECT *, lag(x) OVER (PARTITION BY p_partkey ORDER BY i) AS b FROM u)
SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS cells FROM d WHERE i = 0 OR x IS DISTINCT FROM b GROUP BY p_partkey""")
def echo_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Equal neighbours in a row collapse."""
    r = F.array("p_brand", "p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(tables.without_echo(r), "|").alias("cells"))


@query("""WITH o AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, p_name FROM n UNION ALL SELECT p_partkey, p_name FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)""")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """New rows win by key, others stay."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return edit.upsert(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name")), "p_partkey", "p_name")


def stream_of_events(spark: SparkSession, sf: str, parts: int = 4) -> DataFrame:
    at = place(spark, "stream")
    table(spark, sf, "events").withColumn("part", F.pmod("event_id", F.lit(parts))).repartition(parts, "part").drop("part").write.parquet(at)
    return events.read(spark, at, table(spark, sf, "events").schema)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All of a stream, by micro-batches, as a table of its last state."""
    spark, name = df.sparkSession, "s" + uuid.uuid4().hex
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT user_id, count(*) AS n, max(ts) AS ts, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each key, over several micro-batches."""
    return drained(events.latest(stream_of_events(spark, sf)), "complete").select("user_id", "n", "ts", "event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by time window and type, over several micro-batches."""
    return drained(events.windowed(stream_of_events(spark, sf), late="1000 days"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


TABLE = "<h2>{}</h2><table><tr><th colspan='2'>{}</th><th>{}</th></tr><tr><td rowspan='2'>{}</td><td>{}<br>x</td><td>{}</td></tr><tr><td>u</td><td><b>v</b> &amp; w</td></tr></table>"


def filled(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(c for v, p in zip(values, parts[1:]) for c in (F.coalesce(v, F.lit("")), F.lit(p))))


@query("""SELECT p_partkey, CAST(unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS INTEGER) AS row, CAST(unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS INTEGER) AS col, unnest([p_brand, p_brand, p_type, p_name, CAST(p_size AS VARCHAR) || chr(10) || 'x', p_type, p_name, 'u', 'v & w']) AS text FROM part""")
def span_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of tables with spans, as a dense grid."""
    page = filled(TABLE, F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type"))
    pages = table(spark, sf, "part").select("p_partkey", page.alias("html"))
    return html.cells(pages, "p_partkey", "html").select("p_partkey", "row", "col", "text")


HEAD = ["요건 구분", "상세내용"]
ROW = "<tr><td>{}</td><td>{}</td></tr>"
DUTY = ["접근 통제를 제공하여야 함\n감사 기록을 제공하여야 함", "□K8S Worker CPU 6530P 2socket MEM 512GB", "1,200만", "① 자료를 보관하여야 함\n② 기록을 제공하여야 함"]


def requirement_rows(grids: DataFrame, doc: str) -> DataFrame:
    """(doc, seq, code, category, detail): from the cells of tables to requirement rows.

    Headers decide which tables count and which columns are category and detail; blank categories take the one above,
    details are cut at their marks, noise goes, equal details of a table count once, and rows are numbered by category.
    """
    rows = grids.groupBy(doc, "table", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))  # as many as a row has
    head = rows.filter("row = 0").filter(headers.requirement_table(F.col("cells")))
    category, detail = headers.role_columns(F.col("cells"))
    roles = head.select(F.col(doc).alias("__d"), F.col("table").alias("__t"), category.cast("int").alias("__c"), detail.cast("int").alias("__e"))
    body = rows.filter("row > 0").join(roles, (F.col(doc) == F.col("__d")) & (F.col("table") == F.col("__t")))
    c, d = headers.category_and_detail(F.col("cells"), F.col("__c"), F.col("__e"))
    named = body.select(doc, "table", "row", F.nullif(F.coalesce(c, F.lit("")), F.lit("")).alias("c"), d.alias("detail"))
    carried = order.carry(named, [doc, "table"], "row", F.col("c"), "category", "기타")
    units = carried.select(doc, "table", "row", "category", F.posexplode(tx.marker_pieces(F.col("detail"))).alias("no", "detail")).filter(~gates.is_noise(F.col("detail")))
    first = units.groupBy(doc, "table", tx.sig(F.col("detail")).alias("key")).agg(F.min(F.struct("row", "no", "category", "detail")).alias("u")).select(doc, "table", "u.*")
    seq = F.row_number().over(Window.partitionBy(doc).orderBy("table", "row", "no"))
    numbered = first.withColumn("seq", seq).withColumn("k", F.row_number().over(Window.partitionBy(doc, "category").orderBy("table", "row", "no")))
    return numbered.select(doc, "seq", F.concat_ws("-", "category", F.lpad(F.col("k").cast("string"), 3, "0")).alias("code"), "category", "detail")


@query(r"""WITH d AS (SELECT p_partkey AS doc, unnest(range(0, 4)) AS r, unnest(['보안', '', '성능', '']) AS category, unnest(['접근 통제를 제공하여야 함' || chr(10) || p_name || ' 기록을 제공하여야 함', '□K8S Worker CPU 6530P 2socket MEM 512GB', '1,200만', '① 자료를 보관하여야 함' || chr(10) || '② ' || p_type || '을 제공하여야 함']) AS detail FROM part WHERE p_size % 2 = 0),
c AS (SELECT doc, r, last_value(nullif(category, '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY r) AS category, detail FROM d), u AS (SELECT doc, r, category, unnest(CASE WHEN contains(detail, '①') THEN string_split(detail, chr(10)) ELSE [detail] END) AS detail, unnest(range(0, CASE WHEN contains(detail, '①') THEN 2 ELSE 1 END)) AS no FROM c WHERE r IN (0, 3))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY r, no) AS seq, category || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc, category ORDER BY r, no) AS VARCHAR), 3, '0') AS code, category, detail FROM u""")
def requirement_tables(spark: SparkSession, sf: str) -> DataFrame:
    """G08 in its rule-based part: tables of documents to requirement rows, through P05, P08, P09, W05, T05, P10, D02, W01."""
    p = table(spark, sf, "part")
    top = "<table><tr><th>" + "</th><th>".join(HEAD) + "</th></tr>"
    cells = [("보안", F.concat(F.lit("접근 통제를 제공하여야 함<br>"), F.col("p_name"), F.lit(" 기록을 제공하여야 함"))), ("", F.lit(DUTY[1])), ("성능", F.lit(DUTY[2])), ("", F.concat(F.lit("① 자료를 보관하여야 함<br>② "), F.col("p_type"), F.lit("을 제공하여야 함")))]
    body = F.concat(*(filled(ROW, F.lit(a), b) for a, b in cells))
    other = F.lit("<table><tr><th>회사명</th><th>대표자</th></tr><tr><td>가</td><td>나</td></tr></table>")
    page = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(top), body, F.lit("</table>"))).otherwise(F.lit("")), other)
    grids = html.cells(p.select(F.col("p_partkey").alias("doc"), page.alias("html")), "doc", "html")
    return requirement_rows(grids, "doc").select("doc", F.col("seq").cast("long").alias("seq"), "code", "category", "detail")
