"""Golden cases of the rules for headers, cells, headings and tabs, nulls and empty values included."""

from pyspark.sql import functions as F

from docweave.functions import gates, headers, pieces


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_headers(spark):
    rows = [(["요건 구분", "상세내용"],), (["운영구분", "상세내용"],), (["구 분", "요구사항 상세"],), (["회사명", "대표자"],), ([],), (["주요 역할", "제안 기준"],), (["", None],)]
    h = F.col("h")
    assert values(spark, rows, "h array<string>", headers.looks_required(h)) == [True, False, True, False, False, False, False]
    assert values(spark, rows[:6], "h array<string>", headers.requirement_table(h)) == [True, True, True, False, False, False]
    assert values(spark, rows[:4], "h array<string>", headers.administrative(h)) == [False, False, False, True]
    category, detail = headers.role_columns(h)
    assert values(spark, [(["번호", "구분", "내용"],), (["a", "b"],), (["a"],)], "h array<string>", F.struct(category, detail)) == [(1, 2), (0, 1), (0, 1)]


def test_category_and_detail(spark):
    long = "가" * 45
    category, detail = headers.category_and_detail(F.col("c"), F.lit(0), F.lit(1))
    rows = [(["보안", "짧다", long],), ([long, "짧다", "분류"],), (["보안", "상세"],), ([],)]
    assert values(spark, rows, "c array<string>", F.struct(category, detail)) == [("보안", long), (long, "짧다"), ("보안", "상세"), (None, "")]


def test_noise_and_sections(spark):
    rows = [("□K8S Worker CPU 6530P 2socket MEM 512GB", ""), ("1,200만", ""), ("접근 통제를 구축하여야 함", "H/W 현황"), ("서버 목록", "H/W 현황"), (None, None), ("상세 목록", "2. 요구사항")]
    assert values(spark, rows, "d string, p string", gates.is_noise_row(F.col("d"), F.col("p"), F.lit(""))) == [True, True, False, True, True, False]
    paths = [("1. 개요 > 2. 요청 사항",), ("연혁",), ("",), (None,)]
    assert values(spark, paths, "p string", gates.in_context(F.col("p"))) == [True, False, True, True]


def test_tabs_and_labels(spark):
    assert values(spark, [("1. 정보보호 요청사항",), ("가. 시스템 (공통) 3",), ("[공통]",)], "t string", gates.clean_tab(F.col("t"))) == ["정보보호 요청사항", "시스템", "요구사항"]
    assert values(spark, [("AI 플랫폼",), ("아래와 같이 바랍니다",), ("",), (None,), ("가" * 23,)], "t string", gates.bad_tab(F.col("t"))) == [False, True, True, True, True]
    assert values(spark, [("1",), ("2)",), ("가.",), ("1.1 서버 관리",), (None,)], "t string", gates.clean_label(F.col("t"))) == ["", "", "", "1.1 서버 관리", ""]


def test_pieces(spark):
    t = F.col("t")
    assert values(spark, [("1) 하나요\n2) 둘째 ○ 셋째 항목\n이어짐",), ("• 자료 수집 • 검색함",), ("가",), ("",), (None,), ("a\n\n가나다",)], "t string", pieces.items(t)) == [["1) 하나요", "2) 둘째", "셋째 항목 이어짐"], ["자료 수집", "검색함"], ["가"], [], [], ["a 가나다"]]
    assert values(spark, [("문장 - 하나 - 둘 - 셋",), ("머리\n- 하나\n- 둘",), ("한 줄",), ("",)], "t string", pieces.dashes(t)) == [["문장 - 하나", "- 둘", "- 셋"], ["머리\n- 하나", "- 둘"], ["한 줄"], []]
    got = values(spark, [("□ 보안 관리 ∙ 접근 통제를 위한 절차 수립 □ 성능",), ("계정 신청 - 승인 - 삭제",), ("그대로",), (None,)], "t string", pieces.hierarchy(t))
    assert got == [[("보안 관리", "접근 통제를 위한 절차 수립"), ("", "성능")], [("", "계정 신청 승인 삭제")], [("", "그대로")], None]
    assert values(spark, [(["API", "api ", "", None, "DB", "UI"],), ([],)], "x array<string>", pieces.distinct_spellings(F.col("x"), 2)) == [["API", "DB"], []]
    assert values(spark, [("① 첫 문장이\n이어진다.\n둘째",), ("",)], "t string", pieces.title(t)) == ["첫 문장이 이어진다.", ""]
