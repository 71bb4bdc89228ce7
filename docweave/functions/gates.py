"""Predicates that keep or drop rows, headings, tabs and phrases, as column expressions. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions.headers import any_in, compact

# Patterns and words of the rules.
HARDWARE = r"(?i)□.*(?:CPU|GPU|MEM|socket|Core|GHz|SSD|X\.86|X86|H200|NVMe)"
PROCESSOR = r"(?i)(?:CPU\s+\d{4}P|\d+Core\s+[\d.]+Ghz|2socket\s+MEM|내장\s+Disk)"
VERB = r"해야\s*함|하여야|제시|구축|구현|준수|마련|제공|수립|포함|가능"
STATUS = r"현황|사양|스펙|구성\s*현황|클러스터\s*현황"
SECTIONS = [
    "요청 사항", "요청사항", "요구사항", "요구 사항", "요건", "요구", "기능 요건", "기능 요구", "기술 요건", "상세 요건", "고려사항", "구축 범위", "제공 기능", "프로젝트 범위", "사업 범위", "과업 범위", "구축 대상", "구축 내용",
    "연구개발", "개발 내용", "개발내용", "개발 범위", "개발범위", "과업 내용", "과업내용", "기술개발", "수행 내용", "수행내용", "세부 요구", "세부요구", "상세 요구", "상세요구", "제안 요구", "제안요구",
]
CONTENTS_LINE = r"\.{4,}\s*\d+\s*$"
APPENDIX = r"(?i)서식|붙임|별첨|연혁|이력\s*사항|인력\s*이력|투입\s*인력|동의서|확인서|견적서|제안\s*회사|제안업체\s*일반"
CRITERION = r"(?i)호환|동등|이상|지원|제공|준수|가\s*능|필수|포함|성능|기능|관리|확장"
PROPOSAL = r"(?i)제안요청|요구\s*사항|요청\s*사항|사업\s*내용|제안\s*서\s*작성"
REQUEST = r"(?i)요청|요구|요건|방안|제시|기술하|상세\s*요구|제안\s*기준|고려\s*사항|수행\s*방안|관리\s*방안|지원\s*방안|교육|기술이전|제출"
INVENTORY = r"(?i)당행.*(?:현황|보유|자원)|(?:H/?W|클러스터|쿠버네티스).{0,8}현황|데이터\s*현황|신규\s*도입\s*자원|기존\s*당행|장비\s*사양|사양\s*표"
BACKGROUND = r"(?i)사업\s*추진\s*배경|추진\s*배경|추진\s*목적|기대\s*효과|사업\s*목적|사업\s*추진\s*일정|제안\s*개요"
ZONE = r"(?i)구축\s*방향|요구\s*사항|요청\s*사항|ICT|인프라|정보보호|UX|UI|거버넌스|표준|수행\s*방안|BMT|실증"
REFERENCE = r"(?i)구성도|당사\s*시스템\s*표준|(?<!인프라\s)시스템\s*표준|실증.*시나리오|평가\s*시나리오|제안서\s*작성\s*요령|제안서\s*작성\s*유의"
NOT_REFERENCE = r"(?i)요구\s*사항|요청\s*사항|기술\s*요건|인프라\s*요구"
LEADING_BULLET = r"^[•·▪◦∙\-–—]"
TAB_NUMBER = r"^\s*(?:[IVXLCDM]+[.)]|[가나다라마바사아자차카타파하][.)]|[Ⅰ-Ⅻ]\.?|\d+(?:\.\d+)*\.?)\s+"
TAB_BULLET = r"^\s*[❍○●▪∙•◦·\-–—]\s*"
TAB_BRACKET = r"\[[^\]]*\]|\([^)]*\)|「[^」]*」"
NO_TAB = r"바랍니다|참고하시|다음의|아래와|오류!|책갈피|본\s*사업|다음과\s*같|목적\s*및|추진\s*배경"
TAB_END = "(요구사항|요청사항|요건|방안|범위|개요|표준|관리|지원|교육)$"
TAB_WORD = r"(?i)요구|요청|요건|방안|인프라|보안|UX|UI|데이터|AI|프로젝트"
ORDINAL = r"^\s*(?:\d+(?:\.\d+)*[.)]?|[가-하][.)]|[①-⑩⓪])\s*"
NO_TAB_NAME = "요구사항"
CARD_GROUP = ["제안서 작성 및 유의사항", "제안서 작성 방안", "제안 일반 사항", "제안 일반사항"]
CARD_ANY = [
    "서식", "별첨", "입찰 안내", "담당자", "입찰 일반사항", "제안 요청 및 지침", "제안 서식 및 별첨", "제안 요청서의 효력", "유의 사항", "제안업체 기본요건", "제안서 작성 기준", "제안서 작성 방안", "제안 일반 사항", "제안 일반사항",
    "제출 서류", "제안서 평가", "선정 방안", "기타사항", "가격 제안", "입찰 제안",
]


def is_noise(detail: Column) -> Column:
    """Hardware lines, bare numbers with units, and texts of fewer than two letters or digits."""
    d = tx.norm(F.coalesce(detail, F.lit("")))
    processor = d.startswith("□") & d.rlike(PROCESSOR) & ~d.rlike(VERB)
    return (F.length(tx.sig(d)) < 2) | d.rlike(HARDWARE) | processor | compact(d).rlike(r"^[\d,.만억천+]+$")


def is_section(heading: Column) -> Column:
    """A heading with a word of requirement sections, white space and marks apart."""
    return any_in(F.lower(tx.sig(heading)), sorted({"".join(x.split()) for x in SECTIONS}))


def in_context(path: Column) -> Column:
    """A " > " path with such a section, or without any."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), " > "), lambda p: p.rlike(r"\S"))
    return (F.size(parts) == 0) | F.exists(parts, is_section)


def is_noise_row(detail: Column, path: Column, source: Column) -> Column:
    d, p = F.coalesce(detail, F.lit("")), F.coalesce(path, F.lit(""))
    status = F.concat(F.coalesce(source, F.lit("")), p).rlike(STATUS) & (d.rlike(PROCESSOR) | d.rlike(r"^\s*□"))
    return is_noise(d) | (~d.rlike(VERB) & (~in_context(p) | status))


def reads_required(text: Column) -> Column:
    """A sentence that asks for something, or a numbered or marked line of a list."""
    d = tx.norm(F.coalesce(text, F.lit("")))
    n = F.length(tx.sig(d))
    listed = (d.rlike(r"^\d+\)\s*.") | d.rlike(LEADING_BULLET)) & (n >= 6)
    named = d.rlike("제시|기술|명시|포함|작성|제출|준수") & (n >= 12)
    return (n >= 2) & ~d.rlike(CONTENTS_LINE) & (listed | d.rlike(VERB) | named)


def reads_inventory(text: Column) -> Column:
    d = tx.norm(F.coalesce(text, F.lit("")))
    return (d != "") & ~reads_required(d) & (d.rlike(HARDWARE) | d.rlike(PROCESSOR) | d.rlike(r"^-\s*\(\d+\)\s*(?:기존|신규)"))


def reads_criterion(text: Column) -> Column:
    """A line of a table of criteria, which needs no verb."""
    d = tx.norm(F.coalesce(text, F.lit("")))
    n = F.length(tx.sig(d))
    return (n >= 6) & ~d.rlike(CONTENTS_LINE) & ~reads_inventory(d) & (reads_required(d) | (d.rlike(CRITERION) & (n >= 8)))


def is_appendix(heading: Column) -> Column:
    return tx.norm(heading).rlike(APPENDIX)


def is_reference(heading: Column) -> Column:
    h = tx.norm(heading)
    return ~h.rlike(NOT_REFERENCE) & h.rlike(REFERENCE)


def is_background(heading: Column) -> Column:
    h = tx.norm(heading)
    return ~h.rlike(ZONE) & h.rlike(BACKGROUND)


def is_inventory_heading(heading: Column) -> Column:
    h = tx.norm(heading)
    return ~h.rlike(REQUEST) & h.rlike(INVENTORY)


def collects(headings: Column, sample: Column) -> Column:
    """Whether rows are taken under a chain of headings; the sample's own text decides where it can."""
    chain = F.filter(headings, lambda h: h.rlike(r"\S"))
    s = tx.norm(F.coalesce(sample, F.lit("")))
    outside = (F.size(chain) == 0) | F.forall(chain, lambda h: tx.norm(h).rlike(CONTENTS_LINE)) | F.exists(chain, is_appendix)
    asked = F.exists(chain, lambda h: tx.norm(h).rlike(PROPOSAL) | tx.norm(h).rlike(REQUEST))
    return F.when(outside | reads_inventory(s), False).when(reads_required(s), True).otherwise(~F.exists(chain, is_inventory_heading) & asked)


def clean_tab(segment: Column, most: int = 40) -> Column:
    """Numbers, bullets, brackets and contents leaders taken off; a name for what is left empty."""
    s = tx.norm(segment)
    for _ in range(4):
        s = F.regexp_replace(F.regexp_replace(s, TAB_NUMBER, ""), TAB_BULLET, "")
    s = F.regexp_replace(F.trim(s), TAB_BRACKET, "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[·.…‧\-_\s]{3,}\d*\s*$", ""), r"\s+\d+\s*$", ""))
    return F.substring(F.when(s == "", NO_TAB_NAME).otherwise(s), 1, most)


def bad_tab(name: Column) -> Column:
    """Sentences, and long names without a word of the trade."""
    n = F.length(name)
    long = (n > 38) | ((n > 26) & ~name.rlike(TAB_END)) | ((n > 22) & ~name.rlike(TAB_WORD))
    return F.coalesce((name == "") | (name == NO_TAB_NAME) | long | name.rlike(NO_TAB), F.lit(True))


def clean_label(text: Column) -> Column:
    """Empty for labels that are ordinals only, or have under four characters beyond one."""
    t = tx.norm(F.coalesce(text, F.lit("")))
    bare = t.rlike(r"^\d+$") | (t.rlike(ORDINAL) & ((F.length(t) <= 2) | (F.length(F.trim(F.regexp_replace(t, ORDINAL, ""))) < 4)))
    return F.when(bare, "").otherwise(t)


def skip_card(title: Column, part: Column, section: Column, sub: Column) -> Column:
    """The reason why a card is not read; empty for those that are."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    near = compact(F.concat_ws("|", empty(title), empty(part)))
    far = compact(F.concat_ws("|", *map(empty, (title, part, section, sub))))
    out = F.lit("")
    for words, where, kind in ((CARD_ANY, far, "keyword"), (CARD_GROUP, near, "part_keyword")):
        for w in reversed(words):
            out = F.when(where.contains("".join(w.split())), f"excluded_by_{kind}_{w}").otherwise(out)
    return out


def category_source(strategy: Column, section_index: Column, raw: Column, has_column: Column, unknown: str = "미분류") -> Column:
    """Where a row's category comes from."""
    r = F.trim(F.coalesce(raw, F.lit("")))
    by_column = F.when((r == "") | (r == unknown), "system").otherwise("table")
    by_text = F.when(r == "", "system").otherwise("section")
    return F.when(section_index.isNotNull() | (strategy == "section"), "section").when(strategy == "paragraph", "system").when(has_column, by_column).otherwise(by_text)
