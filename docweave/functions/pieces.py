"""Splits of cells into items, bullets and groups, as column expressions. A null text has no pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx

# Marks that start an item or stand between items, and marks of groups.
LINE_ITEM = r"^(?:[❍○●◦▪▫◆◇■□▣◈▶▷▸‣⁃∙•⦁☞※]|[-–—]\s|\d{1,2}\s*[.)]\s?|[가-힣]\s*[.)]\s|\([0-9가-힣]+\)|[①-⑳]|ㅇ\s)"
BETWEEN = r"\s*(?:[❍○●◦▪▫◆◇▶▷▸‣⁃∙•⦁☞]|<br\s*/?>)\s*|\s+ㅇ\s+"
EDGES = r"^[ ·\-–—\t]+|[ ·\-–—\t]+$"
CELL_MARK = r"\s*([□■◇◆▣∙•·◦▪○●‣①-⑩]|(?<=\s)[-–—](?=\s))\s*"
GROUP_MARK = "□■◇◆▣"
DASH = r"^-\s+"
#: A piece this short (letters and digits) belongs to the piece before it.
SHORT = 10


def title(t: Column) -> Column:
    """The first line of a text with its broken lines joined, without its mark."""
    return F.trim(F.regexp_replace(F.get(F.split(tx.joined_lines(t), "\n"), F.lit(0)), tx.PRIMARY, ""))


def inline(t: Column) -> Column:
    """Between marks; pieces under three characters are dropped."""
    return F.filter(F.transform(F.split(t, BETWEEN), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: F.length(x) >= 3)


def items(t: Column) -> Column:
    """Items of a cell: lines that start with a mark begin one, other lines go on; each is cut at the marks within."""

    def of_lines(lines: Column) -> Column:
        joined = F.split(F.substr(tx.glued(lines, lambda x, i: (i == 0) | x.rlike(LINE_ITEM), " "), F.lit(2)), " " + tx.START)
        cut = F.flatten(F.transform(joined, lambda x: tx.bound(inline(x), lambda p: F.when(F.size(p) > 0, p).when(F.length(F.trim(x)) >= 3, F.array(F.regexp_replace(F.trim(x), EDGES, ""))).otherwise(F.array().cast("array<string>")))))
        return tx.bound(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(tx.norm(t))))

    lines = F.filter(F.transform(F.split(F.replace(t, F.lit(tx.START), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    plain = tx.bound(inline(t), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.trim(t))))
    return F.when(F.coalesce(tx.norm(t), F.lit("")) == "", F.array().cast("array<string>")).when(t.contains("\n"), tx.bound(lines, of_lines)).otherwise(plain)


def dashes(t: Column) -> Column:
    """Dash bullets of a cell: two or more within a line make pieces, the first two stay together; else a dash line ends a piece."""
    lines = F.filter(F.transform(F.split(F.replace(t, F.lit(tx.START), F.lit("")), "\n"), tx.norm), lambda x: x != "")

    def cut(ls: Column) -> Column:
        text = F.array_join(ls, "\n")
        parts = F.filter(F.transform(F.split(text, r"\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")
        several = F.exists(ls, lambda x: x.rlike(DASH)) & (F.size(ls) > 1)
        joined = tx.glued(ls, lambda x, i: (i == 0) | F.get(ls, i - 1).rlike(DASH), "\n")
        by_line = F.split(F.substr(joined, F.lit(2)), "\n" + tx.START)
        rest = lambda p: F.transform(F.slice(p, F.lit(3), F.size(p)), lambda x: F.when(x.startswith("-"), x).otherwise(F.concat(F.lit("- "), x)))
        inner = tx.bound(parts, lambda p: F.when((F.regexp_count(text, F.lit(" - ")) >= 2) & (F.size(p) >= 3), F.concat(F.array(F.concat_ws(" - ", F.get(p, F.lit(0)), F.get(p, F.lit(1)))), rest(p))))
        return F.when(F.size(ls) == 0, F.array().cast("array<string>")).otherwise(F.coalesce(inner, F.when(several, by_line).otherwise(F.array(text))))

    return tx.bound(lines, cut)


def hierarchy(t: Column) -> Column:
    """(group, detail) of a cell: group marks own what follows them, a group without children is a detail; short pieces join the one before."""
    kind = "array<struct<grp:string,detail:string>>"
    marked = F.split(F.regexp_replace(F.replace(t, F.lit(tx.START), F.lit("")), CELL_MARK, tx.START + "$1"), tx.START)
    segments = F.filter(
        F.transform(marked, lambda x, i: F.struct(((i > 0) & F.substring(x, 1, 1).rlike(f"[{GROUP_MARK}]")).alias("head"), F.trim(F.when(i > 0, F.substr(x, F.lit(2))).otherwise(x)).alias("text"))),
        lambda s: s["text"] != "",
    )

    def details(ss: Column) -> Column:
        heads = F.transform(ss, lambda s, i: F.when(s["head"], i))
        group = lambda i: F.array_max(F.slice(heads, F.lit(1), i + 1))
        childless = lambda s, i: s["head"] & F.coalesce(F.get(ss, i + 1)["head"], F.lit(True))
        made = F.transform(ss, lambda s, i: F.when(childless(s, i), F.struct(F.lit("").alias("grp"), s["text"].alias("detail"))).when(~s["head"], F.struct(F.coalesce(F.get(ss, group(i))["text"], F.lit("")).alias("grp"), s["text"].alias("detail"))))
        return F.filter(made, lambda x: x.isNotNull()).cast(kind)

    def joined(ds: Column) -> Column:
        first = F.transform(ds, lambda d, i: (i == 0) | (F.get(ds, i - 1)["grp"] != d["grp"]) | (F.length(tx.sig(d["detail"])) >= SHORT))
        starts = F.filter(F.sequence(F.lit(0), F.size(ds) - 1), lambda i: F.get(first, i))
        ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ds))
        return F.transform(starts, lambda a, k: F.struct(F.get(ds, a)["grp"].alias("grp"), F.array_join(F.transform(F.slice(ds, a + 1, ends(k) - a), lambda d: d["detail"]), " ").alias("detail")))

    one = F.array(F.struct(F.lit("").alias("grp"), F.trim(t).alias("detail"))).cast(kind)
    return F.when(t.isNotNull(), tx.bound(segments, lambda ss: F.when(F.size(ss) <= 1, one).otherwise(tx.bound(details(ss), joined).cast(kind))))


def distinct_spellings(items_: Column, most: int) -> Column:
    """The first spelling of each item, case and outer white space apart, up to a number of items."""

    def pick(ts: Column) -> Column:
        low = F.transform(ts, lambda x: F.lower(x))
        return F.slice(F.filter(ts, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1)), 1, most)

    return tx.bound(F.transform(items_, lambda x: F.trim(F.coalesce(x, F.lit("")))), pick)
