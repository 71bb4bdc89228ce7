"""Rules for headers, cells, headings, tabs and phrases, on fixed examples dealt to the rows of part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import gates, headers
from docweave.plans.registry import query, table

HEADER_ROWS = [
    ["요건 구분", "상세내용"], ["구분", "내용", "비고"], ["운영구분", "CPU", "MEM"], ["회사명", "대표자"], ["요구사항명", "요구사항 상세 설명", ""], ["일 정", "내용"], ["번호", "요구사항 상세", "구 분"], ["주요 역할", "제안 기준"],
    ["기능", "요청 사항"], ["", ""], [], ["① 시스템은 모든 자료를 보관하고 필요할 때 바로 다시 제공할 수 있어야 하며 그 기록을 남긴다", "구분"], ["분류", "구축 범위", "수량"], ["구분구분구분", "상세내용표"],
]
CELL_ROWS = [
    ["보안", "□ 접근 통제와 감사 기록을 제공해야 한다"], ["성능", "응답은 3초 이내"], ["□ 짧다", "x"], ["", "• 자료는 암호화하여 저장하고 열쇠는 따로 관리하여야 하며 주기적으로 바꾼다 그리고 기록한다", "비고"], ["비정형 데이터 플랫폼 구축", "검색", "자료를 모으고 나누어 담은 다음 질의에 맞추어 순서대로 다시 내어 주는 기능을 모두 갖추어야 함"],
    [], ["가", "나", "다"], ["긴 분류 이름이지만 마흔여덟 자를 넘지 않으므로 그대로 쓸 수 있는 이름", "본문은 마흔 자보다 짧다"], ["운영", "운영", "장애가 나면 십 분 안에 알리고 한 시간 안에 복구 계획을 세워 발주자에게 보고해야 합니다"],
]
PATHS = ["1. 사업 개요 > 1.2 추진 배경", "2. 요구사항 > 2.1 기능 요건", "H/W 현황", "", "3. 인프라 구성 현황 > 3.1 서버 사양", "붙임 > 서식 1", "4. 정보보호 요청사항", "제안서 작성 요령", "당사 시스템 표준", "인프라 시스템 표준", "5. 기대 효과", "시스템 구성도 요구 사항", "구축 방향 및 기대 효과", "목차 ....... 12"]
DETAILS = [
    "□K8S Worker CPU 6530P 2socket MEM 512GB", "1,200만", "접근 통제 기능을 제공하여야 함", "-", "□ 서버 목록", "1) 자료 수집 기능", "• 검색 결과 순위", "- (1) 기존 서버 32Core 2.5Ghz", "호환성 및 확장성이 좋은 장비일 것", "상세 규격을 명시하여 제출할 것을 요청", "3. 일정 ........ 14", "자료", "내장 Disk 2TB 이상", "",
]
TABS = [
    "1. 정보보호 요청사항", "가. 시스템 (공통) 3", "- 2.4 데이터 이행 방안 ...... 12", "요구사항", "", "아래와 같이 제안하여 주시기 바랍니다", "본 사업은 다음과 같은 목적으로 추진한다", "이름이 스물두 글자를 넘지만 맞는 낱말이 하나도 없는 제목입니다", "AI 플랫폼 운영", "[공통] 「기반」", "프로젝트 수행 및 품질 관리와 위험 대응에 관한 모든 요구사항", "XIV. 교육", "3", "2) 가",
]
LABELS = ["1", "2)", "가.", "①", "1.1 서버", "1.1 서버 관리", "보안", "", "가. 요건", "가나다라", "12)", "③ 성능", "하. 데이터 표준"]


def pick(values: list, key: str = "p_partkey") -> Column:
    """The example whose turn it is."""
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*map(lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_of(values: list, key: str = "p_partkey") -> str:
    lit = lambda v: "CAST([" + ", ".join(map(lit, v)) + "] AS VARCHAR[])" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(lit, values)) + f"][{key} % {len(values)} + 1]"


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def label_sql(h: str, labels: list[str]) -> str:
    names = ["".join(x.split()) for x in labels]
    c = r"regexp_replace(x, '\s+', '', 'g')"
    tests = [f"{c} = '{x}'" for x in names] + [f"(contains({c}, '{x}') AND length({c}) <= {len(x) + 2})" for x in names if len(x) >= 4]
    return f"(len(list_filter({h}, lambda x: {' OR '.join(tests)})) > 0)"


FILLED = r"list_filter(h, lambda x: regexp_matches(x, '\S'))"
SHORT = "(len({f}) > 0 AND len(list_filter({f}, lambda x: length(x) >= {n})) = 0)"
LOOKS = f"({label_sql('h', headers.CATEGORY)} AND {label_sql('h', headers.DETAIL)})"
JOINED = "array_to_string(h, ' ')"
ADMINISTRATIVE = f"({SHORT.format(f=FILLED, n=80)} AND {any_sql(JOINED, headers.STOP + headers.ADMIN)})"
TIGHT = r"regexp_replace(array_to_string(h, ' '), '\s+', '', 'g')"
OTHER = f"({any_sql(TIGHT, [''.join(x.split()) for x in headers.OTHER_COLUMNS])} AND NOT {label_sql('h', headers.DETAIL)})"
HINTED = f"({any_sql(TIGHT, [''.join(x.split()) for x in headers.TABLE_WORDS])} AND {label_sql('h', headers.CATEGORY + headers.DETAIL + headers.HINTS)})"


@query(f"WITH e AS (SELECT p_partkey, {sql_of(HEADER_ROWS)} AS h FROM part) SELECT p_partkey, {LOOKS} AS looks_required, {ADMINISTRATIVE} AS administrative, NOT {ADMINISTRATIVE} AND ({LOOKS} OR (NOT {OTHER} AND {HINTED})) AS requirement_table FROM e")
def header_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Which headers are those of requirement tables."""
    h = table(spark, sf, "part").select("p_partkey", pick(HEADER_ROWS).alias("h"))
    return h.select("p_partkey", headers.looks_required(F.col("h")).alias("looks_required"), headers.administrative(F.col("h")).alias("administrative"), headers.requirement_table(F.col("h")).alias("requirement_table"))


BODY_CELL = rf"regexp_matches(x, '{headers.BODY}') AND (length(x) >= 30 OR (regexp_matches(x, '^\s*□') AND length(x) >= 12))"
HAS_BODY = "(len(list_filter({a}, lambda x: " + BODY_CELL.replace("{", "{{").replace("}", "}}") + ")) > 0)"
CONTENT = f"(len(list_filter(h, lambda x: regexp_matches(x, '{headers.BODY}') AND length(x) > 40)) > 0)"
STOPS = f"({SHORT.format(f=FILLED, n=80)} AND {any_sql(JOINED, headers.STOP)})"


@query(f"WITH e AS (SELECT p_partkey, {sql_of(HEADER_ROWS)} AS h FROM part) SELECT p_partkey, {SHORT.format(f=FILLED, n=50)} AND {LOOKS} AS short_header, {CONTENT} AS content_first, NOT {STOPS} AND ({LOOKS} OR {CONTENT} OR {HAS_BODY.format(a='h')}) AS goes_on FROM e")
def header_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Short headers, first rows that are content, tables that go on."""
    h = table(spark, sf, "part").select("p_partkey", pick(HEADER_ROWS).alias("h"))
    return h.select("p_partkey", headers.short_header(F.col("h")).alias("short_header"), headers.content_first(F.col("h")).alias("content_first"), headers.continues(F.col("h")).alias("goes_on"))


@query(f"WITH e AS (SELECT p_partkey, {sql_of(CELL_ROWS)} AS c, {sql_of(CELL_ROWS, '(p_partkey + 1)')} AS d FROM part), j AS (SELECT *, list_filter(list_transform([c, d], lambda r: array_to_string(r, ' ')), lambda t: length(t) >= 12) AS js FROM e) SELECT p_partkey, {HAS_BODY.format(a='c')} AS has_body, len(list_filter(js, lambda t: regexp_matches(t, '{headers.BODY}|{'|'.join(headers.SAMPLE_WORDS)}'))) > 0 AS sample_required FROM j")
def body_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a requirement in them, and samples of two rows."""
    e = table(spark, sf, "part").withColumn("next", F.col("p_partkey") + 1).select("p_partkey", pick(CELL_ROWS).alias("c"), pick(CELL_ROWS, "next").alias("d"))
    return e.select("p_partkey", headers.has_body(F.col("c")).alias("has_body"), headers.sample_required(F.array("c", "d")).alias("sample_required"))


LABEL_OK = rf"(length(n) > 0 AND length(n) <= 48 AND NOT regexp_matches(n, '{headers.BODY}') AND n <> '{headers.PROJECT}' AND NOT (contains(n, '{headers.PROJECT}') AND length(n) > {len(headers.PROJECT) + 4}))"


def first_sql(words: list[str]) -> str:
    return rf"nullif(coalesce(list_position(list_transform(h, lambda x: length(trim(x)) BETWEEN 1 AND 40 AND {any_sql('x', words)}), true), 0), 0) - 1"


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(HEADER_ROWS)} AS h, {sql_of(CELL_ROWS)} AS c FROM part), r AS (SELECT *, coalesce({first_sql(headers.CATEGORY)}, 0) AS category, {first_sql(headers.DETAIL)} AS named FROM e),
u AS (SELECT p_partkey, unnest(c) AS t, unnest(range(0, len(c))) AS i FROM e), l AS (SELECT p_partkey, arg_min(i, struct_pack(a := -length(t), b := i)) AS longest FROM u GROUP BY p_partkey),
k AS (SELECT u.p_partkey, min(i) AS label FROM (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS n FROM u) u JOIN l USING (p_partkey) WHERE i <> longest AND {LABEL_OK} GROUP BY u.p_partkey)
SELECT p_partkey, CAST(category AS BIGINT) AS category_col, CAST(coalesce(named, greatest(category + 1, len(h) - 1)) AS BIGINT) AS detail_col, CAST(coalesce(label, 0) AS INTEGER) AS going_category, CAST(coalesce(longest, 0) AS INTEGER) AS going_detail FROM r LEFT JOIN l USING (p_partkey) LEFT JOIN k USING (p_partkey)""")
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Category and detail columns by the header, and of pieces without one."""
    e = table(spark, sf, "part").select("p_partkey", pick(HEADER_ROWS).alias("h"), pick(CELL_ROWS).alias("c"))
    (a, b), (c, d) = headers.role_columns(F.col("h")), headers.continued_columns(F.col("c"))
    return e.select("p_partkey", a.cast("long").alias("category_col"), b.cast("long").alias("detail_col"), c.cast("int").alias("going_category"), d.cast("int").alias("going_detail"))


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(CELL_ROWS)} AS c FROM part), u AS (SELECT p_partkey, unnest(c) AS t, unnest(range(0, len(c))) AS i FROM e), v AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS n FROM u),
b AS (SELECT p_partkey, arg_min(t, struct_pack(a := -length(t), b := i)) FILTER (i <> 0 AND length(t) >= 40) AS best, coalesce(max(t) FILTER (i = 1), '') AS own, max(n) FILTER (i = 0 AND {LABEL_OK}) AS named FROM v GROUP BY p_partkey),
d AS (SELECT e.p_partkey, named, CASE WHEN length(coalesce(own, '')) < 40 THEN coalesce(best, own, '') ELSE own END AS detail FROM e LEFT JOIN b USING (p_partkey)),
s AS (SELECT v.p_partkey, arg_min(n, struct_pack(a := length(n), b := i)) AS shortest FROM v JOIN d USING (p_partkey) WHERE {LABEL_OK} AND t <> detail GROUP BY v.p_partkey)
SELECT p_partkey, CASE WHEN named IS NOT NULL AND named <> detail THEN named ELSE coalesce(shortest, named) END AS category, detail FROM d LEFT JOIN s USING (p_partkey)""")
def category_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Category and detail of rows, with their fallbacks."""
    e = table(spark, sf, "part").select("p_partkey", pick(CELL_ROWS).alias("c"))
    category, detail = headers.category_and_detail(F.col("c"), F.lit(0), F.lit(1))
    return e.select("p_partkey", category.alias("category"), detail.alias("detail"))


N = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
D = N.format("d")
SIG = "regexp_replace({}, '[^0-9A-Za-z가-힣]+', '', 'g')"
NOISE = rf"(length({SIG.format(D)}) < 2 OR regexp_matches({D}, '{gates.HARDWARE}') OR (starts_with({D}, '□') AND regexp_matches({D}, '{gates.PROCESSOR}') AND NOT regexp_matches({D}, '{gates.VERB}')) OR regexp_matches(replace({D}, ' ', ''), '^[\d,.만억천+]+$'))"
SECTION = "regexp_matches(lower(" + SIG.format("{}") + "), '" + "|".join(sorted({"".join(x.split()) for x in gates.SECTIONS})) + "')"
IN_CONTEXT = rf"(len(list_filter(string_split(p, ' > '), lambda x: regexp_matches(x, '\S'))) = 0 OR len(list_filter(string_split(p, ' > '), lambda x: {SECTION.format('x')})) > 0)"


@query(f"WITH e AS (SELECT p_partkey, {sql_of(DETAILS)} AS d, {sql_of(PATHS, '(p_partkey // 14)')} AS p FROM part) SELECT p_partkey, {NOISE} AS noise, {NOISE} OR (NOT regexp_matches(d, '{gates.VERB}') AND (NOT {IN_CONTEXT} OR (regexp_matches(p, '{gates.STATUS}') AND (regexp_matches(d, '{gates.PROCESSOR}') OR regexp_matches(d, '^\\s*□'))))) AS noise_row FROM e")
def noise_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P10: details that are hardware, numbers or nothing, and rows of sections that ask for nothing."""
    e = table(spark, sf, "part").withColumn("k", F.floor(F.col("p_partkey") / 14)).select("p_partkey", pick(DETAILS).alias("d"), pick(PATHS, "k").alias("p"))
    return e.select("p_partkey", gates.is_noise(F.col("d")).alias("noise"), gates.is_noise_row(F.col("d"), F.col("p"), F.lit("")).alias("noise_row"))


@query(f"WITH e AS (SELECT p_partkey, {sql_of(PATHS)} AS p FROM part) SELECT p_partkey, {SECTION.format('p')} AS is_section, {IN_CONTEXT} AS in_context FROM e")
def requirement_sections(spark: SparkSession, sf: str) -> DataFrame:
    """P20: headings, and paths with a heading, of requirement sections."""
    e = table(spark, sf, "part").select("p_partkey", pick(PATHS).alias("p"))
    return e.select("p_partkey", gates.is_section(F.col("p")).alias("is_section"), gates.in_context(F.col("p")).alias("in_context"))


REQUIRED = rf"(length({SIG.format(D)}) >= 2 AND NOT regexp_matches({D}, '{gates.CONTENTS_LINE}') AND (((regexp_matches({D}, '^\d+\)\s*.') OR regexp_matches({D}, '{gates.LEADING_BULLET}')) AND length({SIG.format(D)}) >= 6) OR regexp_matches({D}, '{gates.VERB}') OR (regexp_matches({D}, '제시|기술|명시|포함|작성|제출|준수') AND length({SIG.format(D)}) >= 12)))"
STOCK = rf"({D} <> '' AND NOT {REQUIRED} AND (regexp_matches({D}, '{gates.HARDWARE}') OR regexp_matches({D}, '{gates.PROCESSOR}') OR regexp_matches({D}, '^-\s*\(\d+\)\s*(?:기존|신규)')))"
COLLECTS = rf"""CASE WHEN len(hs) = 0 OR len(list_filter(hs, lambda x: NOT regexp_matches(x, '{gates.CONTENTS_LINE}'))) = 0 OR len(list_filter(hs, lambda x: regexp_matches(x, '{gates.APPENDIX}'))) > 0 OR {STOCK} THEN false WHEN {REQUIRED} THEN true
 ELSE len(list_filter(hs, lambda x: NOT regexp_matches(x, '{gates.REQUEST}') AND regexp_matches(x, '{gates.INVENTORY}'))) = 0 AND len(list_filter(hs, lambda x: regexp_matches(x, '{gates.PROPOSAL}') OR regexp_matches(x, '{gates.REQUEST}'))) > 0 END"""


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(DETAILS)} AS d, {sql_of(PATHS, '(p_partkey // 14)')} AS p FROM part), h AS (SELECT *, list_filter(list_transform(string_split(p, ' > '), lambda x: {N.format('x')}), lambda x: x <> '') AS hs FROM e)
SELECT p_partkey, {REQUIRED} AS required, {STOCK} AS inventory, length({SIG.format(D)}) >= 6 AND NOT regexp_matches({D}, '{gates.CONTENTS_LINE}') AND NOT {STOCK} AND ({REQUIRED} OR (regexp_matches({D}, '{gates.CRITERION}') AND length({SIG.format(D)}) >= 8)) AS criterion, {COLLECTS} AS collects FROM h""")
def content_gates(spark: SparkSession, sf: str) -> DataFrame:
    """What a text reads as, and whether rows are taken under its headings."""
    e = table(spark, sf, "part").withColumn("k", F.floor(F.col("p_partkey") / 14)).select("p_partkey", pick(DETAILS).alias("d"), F.split(pick(PATHS, "k"), " > ").alias("hs"))
    d = F.col("d")
    return e.select("p_partkey", gates.reads_required(d).alias("required"), gates.reads_inventory(d).alias("inventory"), gates.reads_criterion(d).alias("criterion"), gates.collects(F.col("hs"), d).alias("collects"))


REFERENCE_SQL = gates.REFERENCE.replace(r"(?<!인프라\s)", "")


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(PATHS)} AS p FROM part), n AS (SELECT p_partkey, {N.format('p')} AS p FROM e)
SELECT p_partkey, regexp_matches(p, '{gates.APPENDIX}') AS appendix, NOT regexp_matches(p, '{gates.NOT_REFERENCE}') AND regexp_matches(replace(p, '인프라 시스템', ''), '{REFERENCE_SQL}') AS reference, NOT regexp_matches(p, '{gates.ZONE}') AND regexp_matches(p, '{gates.BACKGROUND}') AS background FROM n""")
def heading_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of appendices, references and background."""
    e = table(spark, sf, "part").select("p_partkey", pick(PATHS).alias("p"))
    p = F.col("p")
    return e.select("p_partkey", gates.is_appendix(p).alias("appendix"), gates.is_reference(p).alias("reference"), gates.is_background(p).alias("background"))


STRIPPED = N.format("t")
for _ in range(4):
    STRIPPED = f"regexp_replace(regexp_replace({STRIPPED}, '{gates.TAB_NUMBER}', ''), '{gates.TAB_BULLET}', '')"
CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim({STRIPPED}), '{gates.TAB_BRACKET}', '', 'g'), '[·.…‧\-_\s]{{3,}}\d*\s*$', ''), '\s+\d+\s*$', ''))"


@query(rf"""WITH e AS (SELECT p_partkey, {sql_of(TABS)} AS t FROM part), c AS (SELECT *, substring(CASE WHEN {CLEAN} = '' THEN '{gates.NO_TAB_NAME}' ELSE {CLEAN} END, 1, 40) AS clean FROM e)
SELECT p_partkey, clean, t = '' OR t = '{gates.NO_TAB_NAME}' OR length(t) > 38 OR (length(t) > 26 AND NOT regexp_matches(t, '{gates.TAB_END}')) OR (length(t) > 22 AND NOT regexp_matches(t, '{gates.TAB_WORD}')) OR regexp_matches(t, '{gates.NO_TAB}') AS bad FROM c""")
def tab_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of tabs, cleaned, and which of them are none."""
    e = table(spark, sf, "part").select("p_partkey", pick(TABS).alias("t"))
    return e.select("p_partkey", gates.clean_tab(F.col("t")).alias("clean"), gates.bad_tab(F.col("t")).alias("bad"))


@query(rf"""WITH e AS (SELECT p_partkey, {N.format(sql_of(LABELS))} AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(t, '^\d+$') OR (regexp_matches(t, '{gates.ORDINAL}') AND (length(t) <= 2 OR length(trim(regexp_replace(t, '{gates.ORDINAL}', ''))) < 4)) THEN '' ELSE t END AS label FROM e""")
def clean_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P25: labels that are ordinals only become empty."""
    return table(spark, sf, "part").select("p_partkey", gates.clean_label(pick(LABELS)).alias("label"))


CARDS = ["일반 요건", "유의 사항", "제안서 작성 방안", "가격제안", "보안 요건", "제안 일반 사항"]
NEAR, FAR = (rf"regexp_replace({x}, '\s+', '', 'g')" for x in ("t || '|' || p", "t || '|' || p || '|' || s"))
SKIP = " ".join(f"WHEN contains({where}, '{''.join(w.split())}') THEN 'excluded_by_{kind}_{w}'" for words, where, kind in ((gates.CARD_GROUP, NEAR, "part_keyword"), (gates.CARD_ANY, FAR, "keyword")) for w in words)


@query(f"WITH e AS (SELECT p_partkey, {sql_of(CARDS)} AS t, {sql_of(CARDS, '(p_partkey // 6)')} AS p, {sql_of(CARDS, '(p_partkey // 36)')} AS s FROM part) SELECT p_partkey, CASE {SKIP} ELSE '' END AS reason FROM e")
def skipped_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Why a card is left out, by the words of its titles."""
    e = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 6).alias("k"), F.floor(F.col("p_partkey") / 36).alias("j"))
    return e.select("p_partkey", gates.skip_card(pick(CARDS), pick(CARDS, "k"), pick(CARDS, "j"), F.lit(None).cast("string")).alias("reason"))


@query("""WITH e AS (SELECT p_partkey, ['table', 'section', 'paragraph'][p_partkey % 3 + 1] AS strategy, CASE WHEN p_size = 1 THEN p_size END AS section_index, [NULL, '', '미분류', '보안'][p_partkey % 4 + 1] AS raw, p_partkey % 5 < 3 AS has_column FROM part), r AS (SELECT *, trim(coalesce(raw, '')) AS t FROM e)
SELECT p_partkey, CASE WHEN section_index IS NOT NULL OR strategy = 'section' THEN 'section' WHEN strategy = 'paragraph' THEN 'system' WHEN NOT has_column THEN CASE WHEN t = '' THEN 'system' ELSE 'section' END WHEN t IN ('', '미분류') THEN 'system' ELSE 'table' END AS source FROM r""")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Where categories come from."""
    p = table(spark, sf, "part")
    source = gates.category_source(pick(["table", "section", "paragraph"]), F.when(F.col("p_size") == 1, F.col("p_size")), pick([None, "", "미분류", "보안"]), F.col("p_partkey") % 5 < 3)
    return p.select("p_partkey", source.alias("source"))
