"""Splits of cells, headings and contents, references, restored results and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import pieces
from docweave.functions import text as tx
from docweave.plans.registry import query, table
from docweave.plans.rule_plans import pick, sql_of

CELLS = [
    "① 첫번째 요건\n계속되는 줄\n② 두번째 요건", "• 자료 수집 • 자료 저장 • 검색", "본문 한 줄", "1) 하나\n2) 둘째 항목 ○ 셋째 항목\n이어지는 글", "□ 접근 통제\n- 감사 기록", "안내 - 신청 접수 - 승인 처리 - 삭제", "머리말\n- 첫 항목\n둘째 머리말\n- 둘째 항목\n- 셋째 항목\n꼬리말",
    "□ 보안 관리 ∙ 접근 통제를 위한 절차 수립 ∙ 기록 □ 성능 □ 운영 지원 체계 ∙ 장애 대응 절차와 복구 계획 수립", "앞말 ∙ 계정 신청 ∙ 승인 ∙ 사용자 계정의 삭제와 보관 기간", "", "- 하나뿐", "가 · 나", "<br>줄 바꿈으로 나뉜<br/>항목 둘",
]
LINES_SQL = r"list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
EDGE_SQL = r"regexp_replace({}, '^[ ·\-–—\t]+|[ ·\-–—\t]+$', '', 'g')"
INLINE_SQL = "list_filter(list_transform(regexp_split_to_array({}, '" + pieces.BETWEEN + "'), lambda x: " + EDGE_SQL.format("x") + "), lambda x: length(x) >= 3)"


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(CELLS)} AS t FROM part), u AS (SELECT p_partkey, t, unnest({LINES_SQL}) AS x, unnest(range(0, len({LINES_SQL}))) AS i FROM e WHERE contains(t, chr(10))),
b AS (SELECT *, sum(CASE WHEN i = 0 OR regexp_matches(x, '{pieces.LINE_ITEM}') THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS no FROM u), j AS (SELECT p_partkey, no, string_agg(x, ' ' ORDER BY i) AS x FROM b GROUP BY p_partkey, no),
c AS (SELECT p_partkey, no, CASE WHEN len({INLINE_SQL.format('x')}) > 0 THEN {INLINE_SQL.format('x')} WHEN length(trim(x)) >= 3 THEN [{EDGE_SQL.format('trim(x)')}] ELSE [] END AS ps FROM j), l AS (SELECT p_partkey, flatten(list(ps ORDER BY no)) AS ps FROM c GROUP BY p_partkey)
SELECT p_partkey, array_to_string(CASE WHEN trim(t) = '' THEN [] WHEN contains(t, chr(10)) THEN CASE WHEN len(ps) > 0 THEN ps ELSE [trim(regexp_replace(t, '\s+', ' ', 'g'))] END WHEN len({INLINE_SQL.format('t')}) > 0 THEN {INLINE_SQL.format('t')} ELSE [trim(t)] END, '|') AS items FROM e LEFT JOIN l USING (p_partkey)""")
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a cell, by lines first, then by the marks within."""
    return table(spark, sf, "part").select("p_partkey", F.array_join(pieces.items(pick(CELLS)), "|").alias("items"))


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(CELLS)} AS t FROM part), l AS (SELECT p_partkey, {LINES_SQL} AS ls FROM e), j AS (SELECT *, array_to_string(ls, chr(10)) AS text, list_filter(list_transform(regexp_split_to_array(array_to_string(ls, chr(10)), '\s+-\s+'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM l),
u AS (SELECT p_partkey, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM l), v AS (SELECT *, CASE WHEN i = 0 OR regexp_matches(lag(x) OVER w, '^-\s+') THEN 1 ELSE 0 END AS s FROM u WINDOW w AS (PARTITION BY p_partkey ORDER BY i)), n AS (SELECT *, sum(s) OVER (PARTITION BY p_partkey ORDER BY i) AS no FROM v),
b AS (SELECT p_partkey, list(x ORDER BY no) AS by_line FROM (SELECT p_partkey, no, string_agg(x, chr(10) ORDER BY i) AS x FROM n GROUP BY p_partkey, no) GROUP BY p_partkey)
SELECT p_partkey, array_to_string(CASE WHEN len(ls) = 0 THEN [] WHEN (length(text) - length(replace(text, ' - ', ''))) // 3 >= 2 AND len(ps) >= 3 THEN list_concat([ps[1] || ' - ' || ps[2]], list_transform(ps[3:], lambda x: CASE WHEN starts_with(x, '-') THEN x ELSE '- ' || x END))
 WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^-\s+'))) > 0 THEN by_line ELSE [text] END, '|') AS dashes FROM j LEFT JOIN b USING (p_partkey)""")
def dash_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Dash bullets of a cell."""
    return table(spark, sf, "part").select("p_partkey", F.array_join(pieces.dashes(pick(CELLS)), "|").alias("dashes"))


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(CELLS)} AS t FROM part), m AS (SELECT p_partkey, t, string_split(regexp_replace(t, '\s*([□■◇◆▣∙•·◦▪○●‣①-⑩])\s*|\s+([-–—])\s+|^([-–—])\s+', chr(1) || '\1\2\3', 'g'), chr(1)) AS ms FROM e),
r AS (SELECT p_partkey, i, i > 0 AND regexp_matches(x, '^[{pieces.GROUP_MARK}]') AS head, trim(CASE WHEN i > 0 THEN substring(x, 2) ELSE x END) AS x FROM (SELECT p_partkey, unnest(ms) AS x, unnest(range(0, len(ms))) AS i FROM m)), s AS (SELECT * FROM r WHERE x <> ''),
n AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS n, lead(head) OVER w AS next_head, last_value(CASE WHEN head THEN x END IGNORE NULLS) OVER w AS grp FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
d AS (SELECT p_partkey, i, CASE WHEN head THEN '' ELSE coalesce(grp, '') END AS grp, x FROM n WHERE n > 1 AND (NOT head OR coalesce(next_head, true))),
k AS (SELECT *, CASE WHEN lag(grp) OVER w IS DISTINCT FROM grp OR length(regexp_replace(x, '[^0-9A-Za-z가-힣]+', '', 'g')) >= 10 THEN 1 ELSE 0 END AS st FROM d WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
o AS (SELECT *, sum(st) OVER (PARTITION BY p_partkey ORDER BY i) AS no FROM k), g AS (SELECT p_partkey, no, min(grp) || ':' || string_agg(x, ' ' ORDER BY i) AS x FROM o GROUP BY p_partkey, no), h AS (SELECT p_partkey, string_agg(x, '|' ORDER BY no) AS x FROM g GROUP BY p_partkey)
SELECT p_partkey, coalesce(x, ':' || trim(t)) AS pairs FROM e LEFT JOIN h USING (p_partkey)""")
def cell_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and details within a cell."""
    pairs = F.transform(pieces.hierarchy(pick(CELLS)), lambda p: F.concat_ws(":", p["grp"], p["detail"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pairs, "|").alias("pairs"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(.{40}).*$', '\1') AS s FROM documents) SELECT doc_id, trim(s) AS title FROM m""")
def atom_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of an atom, broken lines joined, without its mark."""
    first = F.regexp_replace(tx.norm(F.col("text")), "^(.{40}).*$", "$1")
    return table(spark, sf, "documents").select("doc_id", pieces.title(F.concat(F.lit("1) "), first)).alias("title"))


@query("""WITH e AS (SELECT p_partkey, [p_name, upper(p_name), ' ' || p_type, p_brand, '', p_type, lower(p_brand)] AS xs FROM part), u AS (SELECT p_partkey, trim(unnest(xs)) AS x, unnest(range(0, 7)) AS i FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(x) ORDER BY i) AS n FROM u WHERE x <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM f WHERE n = 1) SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS phrases FROM r WHERE k <= 2 GROUP BY p_partkey""")
def distinct_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct without case, first spelling, at most two."""
    xs = F.array("p_name", F.upper("p_name"), F.concat(F.lit(" "), F.col("p_type")), "p_brand", F.lit(""), "p_type", F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pieces.distinct_spellings(xs, 2), "|").alias("phrases"))


@query("""WITH v AS (SELECT item_id, unnest([item_id * 3, item_id + 1, item_id * 7, item_id * 3 + 1]) AS id, unnest(range(0, 4)) AS i FROM benchmark), h AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) SELECT item_id, CAST(i AS INTEGER) AS place, id FROM v JOIN h ON id = doc_id""")
def verified_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Verified ids that are among the hits, in the order they were named; others go."""
    ids = F.array(F.col("item_id") * 3, F.col("item_id") + 1, F.col("item_id") * 7, F.col("item_id") * 3 + 1)
    named = table(spark, sf, "benchmark").select("item_id", F.posexplode(ids).alias("place", "id"))
    return named.join(table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), "id").select("item_id", "place", "id")


@query("""WITH e AS (SELECT conv_id, 'c' || conv_id || '-' || turn AS chunk, role || ':' || turn AS named, CAST(turn AS VARCHAR) AS no FROM conversations),
r AS (SELECT DISTINCT conv_id, trim(ref) AS ref FROM (SELECT conv_id, unnest(['c' || conv_id || '-0', 'user:2', ' 1 ', '99', '', 'assistant:2']) AS ref FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE trim(ref) <> ''),
k AS (SELECT conv_id, chunk AS key, chunk, 1 AS p FROM e UNION ALL SELECT conv_id, named, chunk, 1 FROM e UNION ALL SELECT conv_id, no, chunk, 2 FROM e)
SELECT DISTINCT r.conv_id, chunk FROM r JOIN k ON r.conv_id = k.conv_id AND ref = key""")
def chunk_references(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that a review refers to, by chunk id, by source and number, or by the number alone (which may be several)."""
    c = table(spark, sf, "conversations").filter("conv_id IS NOT NULL")
    chunk = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    keys = c.select("conv_id", chunk.alias("chunk"), F.explode(F.array(chunk, F.concat_ws(":", "role", F.col("turn").cast("string")), F.col("turn").cast("string"))).alias("ref"))
    refs = F.array(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-0")), F.lit("user:2"), F.lit(" 1 "), F.lit("99"), F.lit(""), F.lit("assistant:2"))
    asked = c.select("conv_id").distinct().select("conv_id", F.explode(F.transform(refs, lambda x: F.trim(x))).alias("ref")).filter("ref <> ''")
    return asked.join(keys, ["conv_id", "ref"]).select("conv_id", "chunk").distinct()


@query("""WITH old AS (SELECT DISTINCT p_brand, p_size AS code FROM part), new AS (SELECT DISTINCT p_brand, CASE WHEN p_brand < 'Brand#3' THEN p_size ELSE p_size + 1 END AS code FROM part),
d AS (SELECT p_brand, count(*) AS n FROM (SELECT coalesce(old.p_brand, new.p_brand) AS p_brand FROM old FULL JOIN new ON old.p_brand = new.p_brand AND old.code = new.code WHERE old.p_brand IS NULL OR new.p_brand IS NULL) GROUP BY p_brand)
SELECT b.p_brand, coalesce(n, 0) AS n_changed, n IS NULL AS keeps FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN d USING (p_brand)""")
def code_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a document stay if its set of codes is the same as before."""
    p = table(spark, sf, "part")
    both = p.select("p_brand", F.col("p_size").alias("code"), F.lit(1).alias("old"), F.lit(0).alias("new"))
    both = both.unionByName(p.select("p_brand", F.when(F.col("p_brand") < "Brand#3", F.col("p_size")).otherwise(F.col("p_size") + 1).alias("code"), F.lit(0).alias("old"), F.lit(1).alias("new")))
    codes = both.groupBy("p_brand", "code").agg((F.max("old") != F.max("new")).alias("differs"))
    return codes.groupBy("p_brand").agg(F.count_if("differs").alias("n_changed"), (F.count_if("differs") == 0).alias("keeps"))


@query("""WITH r AS (SELECT p_partkey AS id, p_brand || '-' || p_size || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END AS code FROM part), c AS (SELECT p_brand || '-' || p_size AS code, min(p_partkey) AS rec FROM part GROUP BY 1), i AS (SELECT p_partkey AS id, p_partkey + 100000 AS rec FROM part WHERE p_partkey % 10 = 0)
SELECT r.id, coalesce(c.rec, i.rec) AS rec, CASE WHEN c.rec IS NOT NULL THEN 'code' ELSE 'id' END AS bound_by FROM r LEFT JOIN c USING (code) LEFT JOIN i ON i.id = r.id WHERE coalesce(c.rec, i.rec) IS NOT NULL""")
def restored(spark: SparkSession, sf: str) -> DataFrame:
    """Cached results are bound again by code, else by id, else left out."""
    p = table(spark, sf, "part")
    code = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(code, F.when(F.col("p_partkey") % 5 == 0, "x").otherwise("")).alias("code"))
    by_code = p.groupBy(code.alias("code")).agg(F.min("p_partkey").alias("a"))
    by_id = p.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 100000).alias("b"))
    found = rows.join(by_code, "code", "left").join(by_id, "id", "left").filter(F.coalesce("a", "b").isNotNull())
    return found.select("id", F.coalesce("a", "b").alias("rec"), F.when(F.col("a").isNotNull(), "code").otherwise("id").alias("bound_by"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN turn * 2 END AS page, CASE WHEN turn % 5 = 3 THEN turn END AS guess FROM conversations), k AS (SELECT conv_id, count(DISTINCT page) AS n FROM t GROUP BY conv_id)
SELECT t.conv_id, turn, CASE WHEN n < 2 THEN page ELSE coalesce(page, guess, last_value(coalesce(page, guess) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(page IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS page
FROM t JOIN k ON k.conv_id = t.conv_id WINDOW w AS (PARTITION BY t.conv_id ORDER BY turn)""")
def contents_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of contents items: their own, their estimate, the page before, the next known one; nothing is filled with under two known pages."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.col("turn") * 2).alias("page"), F.when(F.col("turn") % 5 == 3, F.col("turn")).alias("guess"))
    known = t.groupBy("conv_id").agg(F.count_distinct("page").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.last(F.coalesce("page", "guess"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("page", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    filled = t.withColumn("to", F.coalesce("page", "guess", before, after)).join(known, "conv_id")
    return filled.select("conv_id", "turn", F.when(F.col("n") < 2, F.col("page")).otherwise(F.col("to")).alias("page"))


TITLES = ["1. 개요", "II. 개요", "개요", "제 1 장 개요", "- 세부 사항", "- 2.1 세부 사항", "• 비고", "2.1 세부 사항", "III) 결론", "결 론", "목차", "Contents", "vi 부록", ""]
KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), '^[ivxlcdm]+\b[.\-)]?\s+', ''), '^\d+(?:\.\d+)*[.\-)]?\s+', ''), '^제\s*\d+\s*(장|절|항)\s*', '')"
LOOSE_SQL = r"regexp_matches(trim(t), '^[\-*•·▪■◆▶◦○□◇※]') AND NOT regexp_matches(regexp_replace(trim(t), '^[\-*•·▪■◆▶◦○□◇※]+\s*', ''), '(?i)^(?:제?\s*\d+\s*(?:장|절|항)|\d+(?:\.\d+)*|[IVXLCDM]+)[.)]?\s+')"


@query(f"""WITH e AS (SELECT p_partkey, p_brand, {sql_of(TITLES)} AS t FROM part), k AS (SELECT *, {KEY_SQL} AS key FROM e WHERE NOT ({LOOSE_SQL}) AND lower(trim(t)) NOT IN ('목차', '목 차', 'contents', 'table of contents')), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, key ORDER BY p_partkey) AS n FROM k WHERE key <> '')
SELECT p_partkey, p_brand, t AS title, key FROM r WHERE n = 1""")
def contents_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Contents items by their title without number, the first of equals; loose bullets and the contents' own heading go."""
    t = tx.norm(F.col("t"))
    key = F.lower(t)
    for numbering in (r"^[ivxlcdm]+\b[.\-)]?\s+", r"^\d+(?:\.\d+)*[.\-)]?\s+", r"^제\s*\d+\s*(장|절|항)\s*"):
        key = F.regexp_replace(key, numbering, "")
    bullet = r"^[\-*•·▪■◆▶◦○□◇※]"
    loose = t.rlike(bullet) & ~F.regexp_replace(t, bullet + r"+\s*", "").rlike(r"(?i)^(?:제?\s*\d+\s*(?:장|절|항)|\d+(?:\.\d+)*|[IVXLCDM]+)[.)]?\s+")
    e = table(spark, sf, "part").select("p_partkey", "p_brand", pick(TITLES).alias("t"))
    kept = e.filter(~loose & ~F.lower(t).isin("목차", "목 차", "contents", "table of contents")).withColumn("key", key).filter("key <> ''")
    first = kept.groupBy("p_brand", "key").agg(F.min(F.struct("p_partkey", "t")).alias("f"))
    return first.select("f.p_partkey", "p_brand", F.col("f.t").alias("title"), "key")


@query("""WITH s AS (SELECT conv_id, count(*) AS n, 1 AS i, CAST(conv_id % 5 AS BIGINT) - 2 AS delta FROM conversations GROUP BY conv_id), m AS (SELECT *, i < n AND delta <> 0 AND i + delta BETWEEN 0 AND n - 1 AS ok, i + delta AS target FROM s)
SELECT c.conv_id, turn, CASE WHEN NOT ok THEN no WHEN no = i THEN target WHEN no > i AND no <= target THEN no - 1 WHEN no < i AND no >= target THEN no + 1 ELSE no END AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM conversations) c JOIN m ON c.conv_id = m.conv_id""")
def contents_moves(spark: SparkSession, sf: str) -> DataFrame:
    """One item of a list is moved by some places, others make room; a move beyond the list changes nothing."""
    c = table(spark, sf, "conversations")
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("i", F.lit(1)).withColumn("target", F.col("i") + F.col("conv_id") % 5 - 2)
    placed = c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("no")).join(sizes, "conv_id")
    no, i, to = F.col("no"), F.col("i"), F.col("target")
    ok = (i < F.col("n")) & (to != i) & to.between(0, F.col("n") - 1)
    place = F.when(~ok, no).when(no == i, to).when((no > i) & (no <= to), no - 1).when((no < i) & (no >= to), no + 1).otherwise(no)
    return placed.select("conv_id", "turn", place.cast("long").alias("place"))


@query("""SELECT source, count(*) AS n, arg_max(text, struct_pack(a := length(text), b := -doc_id)) AS sample FROM documents WHERE text IS NOT NULL GROUP BY source""")
def section_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a section and its longest detail, the first of equals."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("sample"))


NAMES = ["자료 보안", "자료보안", "자료", "자료 정보보호", "접근 통제", "접근통제", "접근  통제 컴플라이언스", "성능"]
NAME_SQL = r"trim(regexp_replace(t, '\s+', ' ', 'g'))"


@query(rf"""WITH e AS (SELECT p_partkey, p_brand, {sql_of(NAMES)} AS t FROM part), k AS (SELECT p_partkey, p_brand, {NAME_SQL} AS name, regexp_replace(regexp_replace({NAME_SQL}, '\s+', '', 'g'), '(?:정보보호|보안|컴플라이언스)$', '') AS key FROM e),
b AS (SELECT p_brand, key, arg_min(name, struct_pack(a := CASE WHEN regexp_matches(name, '정보보호|보안|컴플라이언스') THEN 0 ELSE 1 END, b := -length(name), c := name)) AS best FROM k WHERE key <> '' GROUP BY p_brand, key) SELECT p_partkey, coalesce(best, name) AS name FROM k LEFT JOIN b USING (p_brand, key)""")
def unified_names(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of an item's name take the preferred, else the longest one."""
    suffix = "정보보호|보안|컴플라이언스"
    e = table(spark, sf, "part").select("p_partkey", "p_brand", tx.norm(pick(NAMES)).alias("name"))
    e = e.withColumn("key", F.regexp_replace(F.replace("name", F.lit(" "), F.lit("")), f"(?:{suffix})$", ""))
    rank = F.struct((~F.col("name").rlike(suffix)).alias("a"), (-F.length("name")).alias("b"), F.col("name").alias("c"))
    best = e.filter("key <> ''").groupBy("p_brand", "key").agg(F.min(rank).alias("best"))
    return e.join(best, ["p_brand", "key"], "left").select("p_partkey", F.coalesce("best.c", "name").alias("name"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, regexp_replace(CAST(l_shipdate AS DATE)::VARCHAR, '[^0-9A-Za-z]+', '', 'g') AS s FROM lineitem), k AS (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN substring(s, 1, 2) ELSE substring(s, 1, 4) END AS sig FROM e)
SELECT l_orderkey, kind, sig, min(l_linenumber) AS first_line FROM k WHERE length(sig) >= 3 GROUP BY l_orderkey, kind, sig""")
def distinct_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of a document that agree in kind and signature count once; signatures under three characters go."""
    s = tx.sig(F.date_format("l_shipdate", "yyyy-MM-dd"))
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") % 4 == 0, F.substring(s, 1, 2)).otherwise(F.substring(s, 1, 4)).alias("sig"))
    return e.filter(F.length("sig") >= 3).groupBy("l_orderkey", "kind", "sig").agg(F.min("l_linenumber").alias("first_line"))


@query("""WITH t AS (SELECT conv_id, turn, role, turn % 3 + 1 AS level, 'h' || turn AS title FROM conversations), l AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER w AS t1, max(CASE WHEN level = 2 THEN turn END) OVER w AS t2, max(CASE WHEN level = 3 THEN turn END) OVER w AS t3 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce('h' || t1, '') AS part, CASE WHEN t2 > coalesce(t1, -1) THEN 'h' || t2 ELSE '' END AS section, CASE WHEN t3 > greatest(coalesce(t1, -1), coalesce(t2, -1)) THEN 'h' || t3 ELSE '' END AS category FROM l""")
def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Part, section and category of each heading: the last of each level, forgotten where a higher one begins."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3 + 1).alias("level"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    at = [F.max(F.when(F.col("level") == k, F.col("turn"))).over(w) for k in (1, 2, 3)]
    found = t.select("conv_id", "turn", *(a.alias(f"t{k}") for k, a in enumerate(at, 1)))
    since = [F.lit(-1), F.coalesce("t1", F.lit(-1)), F.greatest(F.coalesce("t1", F.lit(-1)), F.coalesce("t2", F.lit(-1)))]
    names = [F.when(F.col(f"t{k}") > since[k - 1], F.concat(F.lit("h"), F.col(f"t{k}"))).otherwise("").alias(n) for k, n in enumerate(("part", "section", "category"), 1)]
    return found.select("conv_id", "turn", *names)


@query("""WITH s AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS slice FROM conversations) SELECT conv_id, slice, min(turn) AS from_turn, max(turn) AS to_turn, count(*) AS n_blocks FROM s GROUP BY conv_id, slice""")
def section_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks under the heading before them; those before the first are slice 0."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w).alias("slice"))
    return s.groupBy("conv_id", "slice").agg(F.min("turn").alias("from_turn"), F.max("turn").alias("to_turn"), F.count("*").alias("n_blocks"))


@query("""SELECT user_id, count(*) AS n_history, arg_max(event_type, event_id) AS last_stage, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS total_ms FROM events GROUP BY user_id""")
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """What a document's event history comes to when it is exported: events, last stage, elapsed time. Map-side sums, no list."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n_history"), F.max_by("event_type", "event_id").alias("last_stage"), F.floor((F.max(us) - F.min(us)) / 1000).alias("total_ms"))


@query("""WITH p AS (SELECT *, p_size % 7 > 0 AS preset, CASE WHEN p_size % 3 = 0 THEN '요구사항' ELSE p_type END AS tab FROM part), n AS (SELECT p_brand, count(*) FILTER (preset) AS n_preset FROM p GROUP BY p_brand), k AS (SELECT p.*, n_preset FROM p JOIN n USING (p_brand) WHERE preset OR n_preset < 70), t AS (SELECT p_brand, count(DISTINCT tab) AS n_tabs FROM k GROUP BY p_brand)
SELECT p_partkey, tab FROM k JOIN t USING (p_brand) WHERE n_tabs = 1 OR tab <> '요구사항'""")
def preset_tabs(spark: SparkSession, sf: str) -> DataFrame:
    """Loose rows go where enough rows have a preset tab; the fallback tab goes where there are others."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") % 7 > 0).alias("preset"), F.when(F.col("p_size") % 3 == 0, "요구사항").otherwise(F.col("p_type")).alias("tab"))
    n = p.groupBy("p_brand").agg(F.count_if("preset").alias("n_preset"))
    kept = p.join(n, "p_brand").filter("preset OR n_preset < 70")
    tabs = kept.groupBy("p_brand").agg(F.count_distinct("tab").alias("n_tabs"))
    return kept.join(tabs, "p_brand").filter("n_tabs = 1 OR tab <> '요구사항'").select("p_partkey", "tab")
