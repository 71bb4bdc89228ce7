"""Header rows, inherited roles, levels, domains, summaries covered by details, recall by sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import headers
from docweave.functions import text as tx
from docweave.operators import search
from docweave.plans.registry import query, table
from docweave.plans.rule_plans import CELL_ROWS, HEADER_ROWS, pick, sql_of
from docweave.plans.search_plans import GRAMS6

# Words of column headers by role, domains by the words of a tab or text, numbers before a heading.
ROLE_TERMS = [
    "no", "번호", "고유번호", "순번", "요구사항 id", "id", "구분", "분류", "영역", "기능 그룹", "기능그룹", "통제 구분", "요건 구분", "대분류", "중분류", "항목", "항목명", "명칭", "요구사항 명칭", "기능명",
    "상세", "세부", "상세 요건", "상세내역", "상세내용", "상세설명", "내용", "요구사항", "요건", "rfp 요건", "정의", "요구 내용", "비고", "산출", "관련", "담당", "제안서 반영", "수량", "형식", "가능여부", "금액", "단가",
]
TAB_DOMAINS = [
    (r"프로젝트\s*관리|품질보증", "프로젝트 관리"), ("리스크", "리스크 관리"), ("교육|기술이전", "교육 및 기술이전"), ("기술지원", "기술지원"), ("정보보호", "정보보호"), ("거버넌스", "AI 거버넌스"), ("UX|UI", "UXUI"), ("인프라", "인프라"), ("제안개요", "제안개요"),
    (r"수행방안|수행\s*방안", "프로젝트 수행"), ("범위", "프로젝트 범위"),
]
TEXT_DOMAINS = [
    (r"지식베이스\(RAG\)|Knowledge\s*Base|RAG\s*(?:서비스|파이프)", "지식베이스(RAG)"), (r"비정형\s*데이터|Object\s*Storage|파싱|청킹|임베딩|VectorDB|Hybrid.?검색", "비정형 데이터 플랫폼"), ("Agent.?플랫폼|AI Agent|AI Studio|Tool.?Repo|MCP|Lang.?graph", "Agent플랫폼"),
    ("운영.?환경|지속가능|권한.?체계|가드레일", "운영환경"), ("운영자동화|ICT운영", "운영자동화"), ("백업|복구|장애|성능|서버|데이터베이스|OS|컨테이너|인터페이스|클러스터|쿠버네티스", "시스템 일반"), ("정보처리|계정|권한|접근.?통제|취약점|암호", "정보처리시스템"),
    ("개인정보|프라이버시", "개인정보처리시스템"), ("AI.?플랫폼.?보안|생성형.?AI.?보안|프롬프트.?로그", "AI플랫폼보안"), ("연계.?시스템|ESB|API.?게이트", "연계시스템"), ("아키텍처|표준.?아키텍처", "아키텍처"), ("데이터.?거버넌스|학습.?데이터|편향|인공지능.?기본법", "AI 거버넌스"),
]
HEADING_NUMBER = r"^\s*(?:[IVXLC]+|\d+(?:\.\d+)*|[가-힣]|[①-⑩])[.)]\s*"
MOST_LEVELS = 4


def names_columns(row: Column) -> Column:
    """Number of cells with a word of column headers."""
    terms = sorted({"".join(x.split()) for x in ROLE_TERMS})
    return F.size(F.filter(row, lambda c: headers.any_in(F.lower(tx.sig(c)), terms)))


def header_row(rows: Column) -> Column:
    """0 if the first row is a header, else -1: two cells that name columns, or short cells over much longer ones."""

    def over_long(first: Column) -> Column:
        body = F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))
        filled = F.size(F.filter(first, lambda c: c != ""))

        def longer(i: Column) -> Column:
            sizes = F.filter(F.transform(body, lambda r: F.length(F.coalesce(F.get(r, i), F.lit("")))), lambda n: n > 0)
            own = F.length(F.get(first, i))
            return (own > 0) & (F.size(sizes) > 0) & (F.aggregate(sizes, F.lit(0), lambda t, n: t + n) >= F.greatest(F.lit(15), own * 2) * F.size(sizes))

        n = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(first), F.lit(1)) - 1), longer))
        shape = (F.size(rows) >= 3) & (filled >= 2) & F.forall(first, lambda c: F.length(c) <= 12) & (n >= F.greatest(F.lit(1), filled - 1))
        return F.when((names_columns(first) >= 2) | shape, 0).otherwise(-1)

    return F.when(F.size(rows) > 0, tx.bound(F.get(rows, F.lit(0)), over_long)).otherwise(-1)


NAMED = "len(list_filter(h, lambda x: regexp_matches(lower(regexp_replace(x, '[^0-9A-Za-z가-힣]+', '', 'g')), '" + "|".join(sorted({"".join(x.split()) for x in ROLE_TERMS})) + "')))"


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(HEADER_ROWS)} AS h, {sql_of(CELL_ROWS)} AS c, {sql_of(CELL_ROWS, '(p_partkey + 1)')} AS d FROM part), u AS (SELECT p_partkey, h, i, length(h[i]) AS own, coalesce(length(c[i]), 0) AS a, coalesce(length(d[i]), 0) AS b FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM e)),
l AS (SELECT p_partkey, count(*) FILTER (own > 0 AND a + b > 0 AND a + b >= greatest(15, own * 2) * (CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END)) AS n, count(*) FILTER (own > 0) AS filled, max(own) AS most FROM u GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN {NAMED} >= 2 OR (filled >= 2 AND most <= 12 AND n >= greatest(1, filled - 1)) THEN 0 ELSE -1 END AS header_row FROM e LEFT JOIN l USING (p_partkey)""")
def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the first row of a grid is its header."""
    e = table(spark, sf, "part").withColumn("next", F.col("p_partkey") + 1)
    return e.select("p_partkey", header_row(F.array(pick(HEADER_ROWS), pick(CELL_ROWS), pick(CELL_ROWS, "next"))).alias("header_row"))


@query("""WITH g AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'own' || turn WHEN turn % 7 = 5 THEN 'clear' END AS event, turn // 6 AS width FROM conversations),
b AS (SELECT *, count(event) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g), f AS (SELECT *, first_value(event) OVER w AS head, first_value(width) OVER w AS head_width, max(CASE WHEN event IS NULL THEN 1 ELSE 0 END) OVER w AS x FROM b WINDOW w AS (PARTITION BY conv_id, run ORDER BY turn)),
k AS (SELECT *, bool_and(event IS NOT NULL OR width = head_width) OVER (PARTITION BY conv_id, run ORDER BY turn) AS same FROM f)
SELECT conv_id, turn, CASE WHEN head IS NULL OR head = 'clear' OR NOT same THEN NULL ELSE head END AS roles FROM k""")
def inherited_roles(spark: SparkSession, sf: str) -> DataFrame:
    """A table without header takes the roles of the tables before it while widths are equal; other tables clear them."""
    t = F.col("turn")
    g = table(spark, sf, "conversations").select("conv_id", "turn", F.when(t % 4 == 0, F.concat(F.lit("own"), t)).when(t % 7 == 5, "clear").alias("event"), F.floor(t / 6).alias("width"))
    g = g.withColumn("run", F.count("event").over(Window.partitionBy("conv_id").orderBy("turn")))
    w = Window.partitionBy("conv_id", "run").orderBy("turn")
    g = g.withColumn("head", F.first("event").over(w)).withColumn("head_width", F.first("width").over(w))
    same = F.min(F.col("event").isNotNull() | (F.col("width") == F.col("head_width"))).over(w)
    return g.withColumn("same", same).select("conv_id", "turn", F.when(F.col("head").isNull() | (F.col("head") == "clear") | ~F.col("same"), None).otherwise(F.col("head")).alias("roles"))


SECTIONS = ["1. 사업 > 1.1 개요 > 가. 배경", "1. 사업 > 1.1 개요", "1. 사업 > 2.1 범위 > 2.1.1 보안 > 나. 보안", "1. 사업 > 2.1 범위 > ① 자료 > ② 기록 > ③ 보관", "1. 사업", "1. 사업 > 2.1 범위 > 범위"]
TOPS, MIDS = ["", "보안", "자료 기록", "범위"], ["하위", "", "자료"]


def bare(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, HEADING_NUMBER, ""))


def levels(rows: DataFrame, tab: str, path: str, top: str, mid: str, most: int = MOST_LEVELS) -> DataFrame:
    """Adds levels: what a row's path has below the path its tab has in common, then top and mid; the inner ones if they are too many."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(path), F.lit("")), ">"), lambda x: F.trim(x)), lambda x: x != "")
    r = rows.withColumn("__p", parts).withColumn("__b", F.transform("__p", bare))
    ends = r.groupBy(F.col(tab).alias("__t")).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi"))  # what all share, the least and the greatest share
    differs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__lo"), F.size("__hi"))), lambda i: ~F.get("__lo", i).eqNullSafe(F.get("__hi", i)))
    r = r.join(ends.select("__t", F.coalesce(F.array_min(differs), F.size("__lo")).alias("__n")), F.col(tab).eqNullSafe(F.col("__t")))
    below = F.filter(F.slice("__p", F.col("__n") + 1, F.greatest(F.size("__p"), F.lit(1))), lambda x: bare(x) != "")

    def joined(ps: Column) -> Column:
        own = F.filter(ps, lambda x, i: (i == 0) | (bare(x) != bare(F.get(ps, i - 1))))

        def slots(ls: Column) -> Column:
            t, m = F.trim(F.coalesce(F.col(top), F.lit(""))), F.trim(F.coalesce(F.col(mid), F.lit("")))
            last, b = F.coalesce(bare(F.element_at(ls, -1)), F.lit("")), bare(t)
            echo = (F.size(ls) > 0) & (t != "") & (b != "") & (last.contains(b) | b.contains(last))
            t = F.when(echo, "").otherwise(t)
            pair = F.when(m != "", F.array(t, m)).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))
            return tx.bound(F.concat(ls, pair), lambda x: F.slice(x, F.greatest(F.size(x) - most, F.lit(0)) + 1, F.lit(most)))

        return tx.bound(own, lambda o: F.when(F.size(o) > 0, slots(o)).otherwise(slots(F.array().cast("array<string>"))))

    return r.withColumn("levels", tx.bound(below, joined)).drop("__p", "__b", "__t", "__n")


BARE = "trim(regexp_replace({}, '" + HEADING_NUMBER + "', ''))"


@query(rf"""WITH e AS (SELECT p_partkey, p_brand AS tab, list_transform(string_split({sql_of(SECTIONS)}, '>'), lambda x: trim(x)) AS p, {sql_of(TOPS)} AS t, {sql_of(MIDS)} AS m FROM part WHERE p_partkey % 6 < CASE WHEN p_brand < 'Brand#3' THEN 6 ELSE 4 END),
u AS (SELECT tab, p_partkey, unnest(range(1, len(p) + 1)) AS i, unnest(list_transform(p, lambda x: {BARE.format('x')})) AS b FROM e), s AS (SELECT tab, i, count(*) AS n, count(DISTINCT b) AS k FROM u GROUP BY tab, i), z AS (SELECT tab, count(*) AS n FROM e GROUP BY tab),
c AS (SELECT z.tab, coalesce(min(i) FILTER (s.n < z.n OR k > 1), max(i) + 1) - 1 AS common FROM z JOIN s USING (tab) GROUP BY z.tab), w AS (SELECT e.*, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x, common FROM e JOIN c USING (tab)),
k AS (SELECT p_partkey, list(x ORDER BY i) AS ls FROM (SELECT *, lag({BARE.format('x')}) OVER (PARTITION BY p_partkey ORDER BY i) AS before FROM w WHERE i > common AND {BARE.format('x')} <> '') WHERE before IS DISTINCT FROM {BARE.format('x')} GROUP BY p_partkey),
a AS (SELECT e.p_partkey, coalesce(ls, []) AS ls, m, CASE WHEN len(coalesce(ls, [])) > 0 AND t <> '' AND (contains({BARE.format('ls[-1]')}, {BARE.format('t')}) OR contains({BARE.format('t')}, {BARE.format('ls[-1]')})) THEN '' ELSE t END AS t FROM e LEFT JOIN k USING (p_partkey)),
j AS (SELECT p_partkey, list_concat(ls, CASE WHEN m <> '' THEN [t, m] WHEN t <> '' THEN [t] ELSE [] END) AS x FROM a) SELECT p_partkey, array_to_string(x[greatest(len(x) - 3, 1):], '|') AS levels FROM j""")
def level_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of rows under their tab."""
    e = table(spark, sf, "part").filter(F.col("p_partkey") % 6 < F.when(F.col("p_brand") < "Brand#3", 6).otherwise(4))
    rows = e.select("p_partkey", F.col("p_brand").alias("tab"), pick(SECTIONS).alias("p"), pick(TOPS).alias("t"), pick(MIDS).alias("m"))
    return levels(rows, "tab", "p", "t", "m").select("p_partkey", F.array_join("levels", "|").alias("levels"))


TEXTS = ["RAG 서비스를 구축", "백업과 복구 절차", "계정 권한 관리", "개인정보 보호", "esb 연계", "일반 문장", "", "표준 아키텍처", "학습 데이터 편향", "가드레일 적용"]
TABS = ["인프라", "", "제안 개요", "ui 설계", "프로젝트 관리", "기타", "수행 방안"]


def domain(text: Column, tab: Column) -> Column:
    """The first domain whose words the tab has, else the text; empty if none."""
    out = F.lit("")
    for where, rules in ((text, TEXT_DOMAINS), (tab, TAB_DOMAINS)):
        for pattern, name in reversed(rules):
            out = F.when(F.coalesce(where, F.lit("")).rlike("(?i)" + pattern), name).otherwise(out)
    return out


CASES = " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{name}'" for x, rules in (("tab", TAB_DOMAINS), ("t", TEXT_DOMAINS)) for p, name in rules)


@query(f"WITH e AS (SELECT p_partkey, {sql_of(TEXTS)} AS t, {sql_of(TABS, '(p_partkey // 10)')} AS tab FROM part) SELECT p_partkey, CASE {CASES} ELSE '' END AS domain FROM e")
def domains(spark: SparkSession, sf: str) -> DataFrame:
    """The domain of a text, by its tab first."""
    e = table(spark, sf, "part").withColumn("k", F.floor(F.col("p_partkey") / 10))
    return e.select("p_partkey", domain(pick(TEXTS), pick(TABS, "k")).alias("domain"))


@query(r"""WITH r AS (SELECT conv_id, turn, text, role = 'user' AND turn % 2 = 0 AS scope, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM conversations WHERE text IS NOT NULL),
d AS (SELECT conv_id, turn, scope, CASE WHEN scope AND conv_id % 2 = 0 THEN coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY turn), s) ELSE text END AS detail FROM r),
u AS (SELECT conv_id, string_agg(regexp_replace(detail, '[^0-9A-Za-z가-힣]+', '', 'g'), '' ORDER BY turn) AS whole FROM d WHERE NOT scope GROUP BY conv_id),
g AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(range(1, length(detail) - 6), lambda i: substring(detail, i, 8)))) AS gram FROM d WHERE scope AND length(regexp_replace(detail, '[^0-9A-Za-z가-힣]+', '', 'g')) >= 12),
c AS (SELECT conv_id, turn FROM g LEFT JOIN u USING (conv_id) GROUP BY conv_id, turn HAVING count(*) FILTER (contains(coalesce(whole, ''), gram)) >= CAST(0.55 AS DOUBLE) * count(*))
SELECT conv_id, turn FROM d ANTI JOIN c USING (conv_id, turn)""")
def scope_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Summary rows go if 55 % of their 8-grams are in the details of their document."""
    r = table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text", ((F.col("role") == "user") & (F.col("turn") % 2 == 0)).alias("scope"), tx.sig(F.col("text")).alias("s"))
    follow = F.coalesce(F.lead("s").over(Window.partitionBy("conv_id").orderBy("turn")), F.col("s"))
    d = r.select("conv_id", "turn", "scope", F.when(F.col("scope") & (F.col("conv_id") % 2 == 0), follow).otherwise(F.col("text")).alias("detail"))
    parts = F.sort_array(F.collect_list(F.struct("turn", tx.sig(F.col("detail")).alias("s"))))
    whole = d.filter("NOT scope").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("whole"))
    marked = d.withColumn("grams", F.when(F.col("scope") & (F.length(tx.sig(F.col("detail"))) >= 12), tx.grams(F.col("detail"), 8))).join(whole, "conv_id", "left")
    inside = F.size(F.filter("grams", lambda g: F.coalesce(F.col("whole"), F.lit("")).contains(g)))
    return marked.filter(F.col("grams").isNull() | (inside < F.lit(0.55) * F.size("grams"))).select("conv_id", "turn")


@query(f"""WITH g AS (SELECT item_id, unnest({GRAMS6}) AS gram FROM (SELECT item_id, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM benchmark)), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
o AS (SELECT r, unnest({GRAMS6}) AS gram FROM (SELECT row_number() OVER () AS r, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') AS s FROM documents)), m AS (SELECT item_id, max(m) AS m FROM (SELECT item_id, r, count(*) AS m FROM g JOIN o USING (gram) GROUP BY item_id, r) GROUP BY item_id)
SELECT 'sheet' || item_id % 4 AS sheet, count(*) AS n_gold, count(*) FILTER (round(coalesce(m, 0) / n, 6) >= 0.6) AS n_found, round(count(*) FILTER (round(coalesce(m, 0) / n, 6) >= 0.6) / count(*), 6) AS recall FROM n LEFT JOIN m USING (item_id) GROUP BY 1""")
def package_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Gold items covered by the output, by sheet."""
    found = search.coverage(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "text")
    sheet = F.concat(F.lit("sheet"), (F.col("item_id") % 4).cast("string"))
    return found.groupBy(sheet.alias("sheet")).agg(F.count("*").alias("n_gold"), F.count_if("covered").alias("n_found"), F.round(F.count_if("covered") / F.count("*"), 6).alias("recall"))
