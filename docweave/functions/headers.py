"""Rules for table headers and columns as column expressions over arrays of cell texts.

Null cells count as empty; a null or empty array has no header, no body and no columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx

# Words of headers and bodies.
CATEGORY = ["요건 구분", "요건구분", "구분", "구 분"]
DETAIL = ["상세내용", "상세 내용", "내용", "요구사항", "요구사항 상세", "구축 범위", "요구 내용", "요구사항명", "요건명"]
HINTS = ["요건", "요구", "요청", "기능", "성능", "항목", "분류", "명칭"]
STOP = ["제출 서류", "제출서류", "회사명", "입찰보증", "생년월일", "제안 참불", "비밀유지확약서", "일 정", "일정", "RFP 발송", "제안 마감", "표준 환경", "목 차", "목차"]
ADMIN = ["회사명", "대표자", "생년월일", "업종", "기관명", "Key Contact", "총자본", "자기자본", "매출원가", "개인(신용)정보", "동의서", "목 차", "목차"]
OTHER_COLUMNS = ["주요 역할", "제안 기준", "운영구분", "CPU", "GPU", "MEM", "Socket", "VRAM", "Core", "Type", "모델", "수량"]
TABLE_WORDS = ["요구", "요건", "요청", "요구사항", "상세내용", "상세 내용", "구축 범위", "요구 내용"]
SAMPLE_WORDS = ["제공", "구축", "제안", "개발", "지원", "연계", "구현"]
BODY = "[①②③④⑤⑥⑦⑧⑨⑩•·□○●∙]|해야 합니다|제공해야|제안해야|구축해야|수행해야"
PROJECT = "비정형 데이터 플랫폼 구축"


def compact(t: Column) -> Column:
    return F.regexp_replace(t, tx.SPACE, "")


def any_in(t: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text."""
    return reduce(Column.__or__, (t.contains(w) for w in words))


def labelled(header: Column, labels: list[str]) -> Column:
    """Whether a cell is one of the labels, white space apart; labels of four or more characters may have two more around them."""
    names = ["".join(x.split()) for x in labels]

    def fits(cell: Column) -> Column:
        c = compact(cell)
        longer = [c.contains(x) & (F.length(c) <= len(x) + 2) for x in names if len(x) >= 4]
        return reduce(Column.__or__, longer, c.isin(*names))

    return F.coalesce(F.exists(header, lambda h: tx.bound(h, fits)), F.lit(False))


def looks_required(header: Column) -> Column:
    return labelled(header, CATEGORY) & labelled(header, DETAIL)


def filled(header: Column) -> Column:
    return F.filter(header, lambda h: h.rlike(r"\S"))


def short_cells(header: Column, most: int) -> Column:
    """Whether there is a filled cell, and all of them are under `most` characters."""
    return tx.bound(filled(header), lambda f: (F.size(f) > 0) & F.forall(f, lambda h: F.length(h) < most))


def stops(header: Column) -> Column:
    return short_cells(header, 80) & any_in(F.array_join(header, " "), STOP)


def administrative(header: Column) -> Column:
    """Forms, schedules and lists of documents: not requirements."""
    return short_cells(header, 80) & any_in(F.array_join(header, " "), STOP + ADMIN)


def requirement_table(header: Column) -> Column:
    joined = F.array_join(header, " ")
    tight = compact(joined)
    other = any_in(tight, ["".join(x.split()) for x in OTHER_COLUMNS]) & ~labelled(header, DETAIL)
    hinted = any_in(tight, ["".join(x.split()) for x in TABLE_WORDS]) & labelled(header, CATEGORY + DETAIL + HINTS)
    return ~administrative(header) & (looks_required(header) | (~other & hinted))


def short_header(header: Column) -> Column:
    return short_cells(header, 50) & looks_required(header)


def content_first(header: Column) -> Column:
    return F.exists(header, lambda h: h.rlike(BODY) & (F.length(h) > 40))


def has_body(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.rlike(BODY) & ((F.length(c) >= 30) | (c.rlike(r"^\s*□") & (F.length(c) >= 12))))


def continues(cells: Column) -> Column:
    """A table that goes on from the page before, by its first row."""
    return ~stops(cells) & (looks_required(cells) | content_first(cells) | has_body(cells))


def sample_required(rows: Column) -> Column:
    """rows: an array of rows of cells."""
    joined = F.filter(F.transform(rows, lambda r: F.array_join(r, " ")), lambda t: F.length(t) >= 12)
    return F.exists(joined, lambda t: t.rlike(BODY) | any_in(t, SAMPLE_WORDS))


def category_label(t: Column) -> Column:
    """The label, white space collapsed, if it is short and no body text; else null."""
    n = tx.norm(t)
    title = (n == PROJECT) | (n.contains(PROJECT) & (F.length(n) > len(PROJECT) + 4))
    return F.when((F.length(n) > 0) & (F.length(n) <= 48) & ~n.rlike(BODY) & ~title, n)


def first_where(items: Column, test) -> Column:
    """Number from 0 of the first item that passes; null if none does."""
    return F.nullif(F.array_position(F.transform(items, test), F.lit(True)), F.lit(0)) - 1


def role_columns(header: Column) -> tuple[Column, Column]:
    """(category, detail) numbers of the columns; the first, and the last, where no label names them."""
    short = lambda h: tx.bound(F.trim(h), lambda t: (F.length(t) > 0) & (F.length(t) <= 40))
    category = F.coalesce(first_where(header, lambda h: short(h) & any_in(h, CATEGORY)), F.lit(0))
    detail = first_where(header, lambda h: short(h) & any_in(h, DETAIL))
    return category, F.coalesce(detail, F.greatest(category + 1, F.size(header).cast("long") - 1))


def longest(items: Column) -> Column:
    """Number from 0 of the longest text, the first of equals."""
    sizes = F.transform(items, lambda t: F.length(t))
    return F.array_position(sizes, F.array_max(sizes)) - 1


def continued_columns(texts: Column) -> tuple[Column, Column]:
    """(category, detail) of a piece without header: the longest text is the detail, the first label the category."""
    detail = longest(texts)
    tagged = F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    label = F.filter(tagged, lambda x: (x["i"] != detail) & category_label(x["t"]).isNotNull())
    empty = F.size(texts) == 0
    return F.when(empty, F.lit(0)).otherwise(F.coalesce(F.get(label, F.lit(0))["i"], F.lit(0))), F.when(empty, F.lit(0)).otherwise(detail.cast("int"))


def category_and_detail(texts: Column, category_col: Column, detail_col: Column) -> tuple[Column, Column]:
    """A row's category and detail. A detail under 40 characters gives way to the longest other cell of 40 or more; a missing category to the shortest label."""
    tagged = F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    best = F.get(F.array_sort(F.filter(tagged, lambda x: (x["i"] != category_col) & (x["n"] <= -40))), F.lit(0))["t"]
    own = F.coalesce(F.get(texts, detail_col), F.lit(""))
    detail = F.when(F.length(own) < 40, F.coalesce(best, own)).otherwise(own)
    named = category_label(F.get(texts, category_col))
    labels = F.filter(F.transform(texts, lambda t, i: F.struct(F.length(category_label(t)).alias("n"), i.alias("i"), t.alias("t"))), lambda x: x["n"].isNotNull() & (x["t"] != detail))
    shortest = category_label(F.get(F.array_sort(labels), F.lit(0))["t"])
    return F.when(named.isNotNull() & (named != detail), named).otherwise(F.coalesce(shortest, named)), detail
