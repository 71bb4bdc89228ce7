"""Table shapes: statistics of grids, junk and header rows, trimming, pivots and partitions, fragment scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx

NUMERIC = r"^[0-9.,%/()\-+ ]+$"
#: Marks before a label, bullets, verbs of duties, and ornaments.
LABEL = r"(?i)^(?:[①-⑩]|\(?[0-9]+(?:\.[0-9]+)*[).\-]|[가나다라마바사아자차카타파하][.)]|[ivxlcdm]+[).])[ \t]+"
BULLETED = r"^[•▪■◆▶◦○□◇·ㆍ−–—\-*]+[ \t]+"
DUTY = "해야|하여야|제공|지원|수행|구성|관리|검증|확인|포함|필요|제시|운영"
ORNAMENT = r"^[-=_*~·•.─━│┃┌┐└┘├┤┬┴┼ \t]+$"


def full(c: str) -> Column:
    return F.coalesce(tx.norm(F.col(c)) != "", F.lit(False))


def grid_stats(cells: DataFrame, table: str, text: str, col: str) -> DataFrame:
    """Per table: columns, filled cells, share of numeric ones, longest cell."""
    t = tx.norm(F.col(text))
    return cells.groupBy(table).agg((F.max(col) + 1).cast("long").alias("n_cols"), F.count_if(full(text)).alias("n_filled"), F.round(F.avg(F.when(full(text), t.rlike(NUMERIC).cast("int"))), 6).alias("numeric"), F.coalesce(F.max(F.when(full(text), F.length(t))), F.lit(0)).cast("long").alias("longest"))


def junk(stats: DataFrame) -> DataFrame:
    """Under two filled cells, mostly numbers, six columns or more, or no cell of 15 characters."""
    return stats.withColumn("junk", (F.col("n_filled") < 2) | (F.coalesce("numeric", F.lit(0.0)) > 0.45) | (F.col("n_cols") >= 6) | (F.col("longest") < 15))


def trimmed(cells: DataFrame, table: str, col: str, text: str) -> DataFrame:
    """Cells between a table's first and last column with anything in it; inner empty columns stay."""
    edges = cells.filter(full(text)).groupBy(F.col(table).alias("__t")).agg(F.min(col).alias("__a"), F.max(col).alias("__b"))
    return cells.join(edges, F.col(table) == F.col("__t")).filter(F.col(col).between(F.col("__a"), F.col("__b"))).drop("__t", "__a", "__b")


def without_echo(row: Column) -> Column:
    """Equal neighbours in a row of cells collapse into one."""
    return F.filter(row, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(row, i - 1)))


def ornament(line: Column) -> Column:
    return line.rlike(ORNAMENT)


def boundary_groups(rows: DataFrame, table: str, row: str, key: str, name: str = "grp") -> DataFrame:
    """A new group begins where the key cell is filled and differs from the last filled one."""
    w = Window.partitionBy(table).orderBy(row)
    value = F.when(full(key), F.col(key))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(value.isNotNull() & (before.isNull() | (value != before)), 1).otherwise(0)
    return rows.withColumn("__s", starts).withColumn(name, F.sum("__s").over(w)).drop("__s")


def form_rows(pairs: DataFrame, form: str, seq: str, label: str, value: str, roles: dict[str, str], key: str) -> DataFrame:
    """Label/value rows of forms to one row per block: a label of the role `key` begins a block; later values of a role are appended.

    roles maps a role to a pattern of its labels. Rows before the first block are a block of their own; labels without a
    role go on the value before them and are left out here.
    """
    role = F.lit(None).cast("string")
    for r, pattern in roles.items():
        role = F.when(F.col(label).rlike(pattern), r).otherwise(role)
    w = Window.partitionBy(form).orderBy(seq)
    marked = pairs.withColumn("__role", role).withColumn("block", F.sum(F.when(role == key, 1).otherwise(0)).over(w))
    values = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__role") == r, F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))), lambda x: x["v"]), "\n")
    return marked.groupBy(form, "block").agg(*(values(r).alias(r) for r in roles))


def column_rules(cells: Column) -> Column:
    """(item, requirement, detail) of a row by its number of cells.

    1: detail; 2: requirement, detail; 3: item, requirement, detail; 4: as 3, the fourth goes on the detail after " / ";
    more: the first is the requirement, all others that are filled make the detail. Rows without a filled cell give null.
    """
    n, at, none = F.size(cells), lambda i: F.coalesce(F.trim(F.get(cells, F.lit(i))), F.lit("")), F.lit("")
    filled = lambda a: F.array_join(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""), " / ")
    four = F.concat(at(2), F.when(at(3) != "", F.concat(F.lit(" / "), at(3))).otherwise(none))
    detail = F.when(n == 1, at(0)).when(n == 2, at(1)).when(n == 3, at(2)).when(n == 4, F.trim(four)).otherwise(filled(F.slice(cells, F.lit(2), F.greatest(n, F.lit(1)))))
    made = F.struct(
        F.when(n.isin(3, 4), at(0)).otherwise(none).alias("item"),
        F.when((n == 2) | (n >= 5), at(0)).when(n.isin(3, 4), at(1)).otherwise(none).alias("requirement"),
        detail.alias("detail"),
    )
    return F.when(filled(cells) != "", made)


def continuity(text: Column) -> Column:
    """(labels + half of other short lines) / lines of a fragment; 0 under two lines, or for sentences without labels.

    Labels are lines with a mark, with a colon, or short lines after a bullet: 14 characters without white space, or 24 without a verb.
    """

    def kind(line: Column) -> Column:
        tight = F.length(F.regexp_replace(line, tx.SPACE, ""))
        bullet = line.rlike(BULLETED) & ((tight <= 14) | ((tight <= 24) & ~F.regexp_replace(line, tx.SPACE, "").rlike(DUTY)))
        return F.when(line.rlike(LABEL) | line.rlike("[:：]") | bullet, 1.0).when((tight >= 35) | line.rlike("[.?!]$"), 0.0).otherwise(0.5)

    def score(kinds: Column) -> Column:
        has = lambda k: F.exists(kinds, lambda x: x == k)
        return F.when((F.size(kinds) < 2) | (has(0.0) & ~has(1.0)), 0.0).otherwise(F.round(F.aggregate(kinds, F.lit(0.0), lambda t, x: t + x) / F.size(kinds), 2))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: tx.norm(x)), lambda x: x != "")
    return tx.bound(F.transform(lines, kind), score)


def suspicion(rows: DataFrame, table: str, n_cells: str, n_spans: str, text: str) -> DataFrame:
    """Score per table: ragged rows 2, a later row of one cell 1.5, spans up to 2, six rows 0.5, hardly any text 0.5."""
    s = rows.groupBy(table).agg(F.count("*").alias("n_rows"), F.countDistinct(n_cells).alias("widths"), F.min(n_cells).alias("least"), F.sum(n_spans).alias("spans"), F.sum(F.length(text)).alias("chars"))
    score = F.when(F.col("widths") > 1, 2.0).otherwise(0.0) + F.when((F.col("n_rows") > 1) & (F.col("least") <= 1), 1.5).otherwise(0.0) + F.least(F.lit(2.0), F.col("spans") * 0.5) + F.when(F.col("n_rows") >= 6, 0.5).otherwise(0.0) + F.when(F.coalesce("chars", F.lit(0)) < 30, 0.5).otherwise(0.0)
    return s.select(table, "n_rows", score.alias("score"))
