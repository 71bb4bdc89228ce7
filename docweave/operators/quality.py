"""Statistics and audits of extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.order import running


def column_stats(cells: DataFrame, table: str, col: str, row: str, text: str) -> DataFrame:
    """Per table and column: non-empty, code and numeric shares, mean and longest length of non-empty cells, adjacent repeats."""
    t = F.trim(F.col(text))
    full = F.coalesce(t != "", F.lit(False))
    w = Window.partitionBy(table, col).orderBy(row)
    rep = cells.withColumn("__again", F.coalesce((F.lag(text).over(w) == F.col(text)) & full, F.lit(False)))
    return rep.groupBy(table, col).agg(
        F.count("*").alias("n_cells"),
        F.round(F.avg(full.cast("int")), 6).alias("filled"),
        F.round(F.avg(F.when(full, F.length(t))), 6).alias("mean_length"),
        F.max(F.when(full, F.length(t))).cast("long").alias("longest"),
        F.round(F.avg(F.when(full, tx.looks_like_code(t).cast("int"))), 6).alias("codes"),
        F.round(F.avg(F.when(full, t.rlike(r"^[0-9.,%-]+$").cast("int"))), 6).alias("numeric"),
        F.round(F.avg(F.col("__again").cast("int")), 6).alias("repeats"),
    )


def consistency(rows: DataFrame, group: str, seq: str, rid: str, tab: str, detail: str, label: str) -> DataFrame:
    """(kind, n): empty details, empty tabs, ids seen before in a group, labels that repeat the row before."""
    w = Window.partitionBy(group).orderBy(seq)
    seen = rows.groupBy(F.col(group).alias("__g"), F.col(rid).alias("__rid")).agg(F.min(seq).alias("__first"))
    marked = rows.join(seen, (rows[group] == F.col("__g")) & (rows[rid] == F.col("__rid")), "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    again = F.coalesce(F.col(seq) > F.col("__first"), F.lit(False)) & ~blank(rid)
    redundant = F.coalesce(F.col(label) == F.lag(label).over(w), F.lit(False)) & ~blank(label)
    kinds = {"empty_detail": blank(detail), "empty_tab": blank(tab), "duplicate_id": again, "redundant_label": redundant}
    one = marked.select(*(v.alias(k) for k, v in kinds.items())).agg(*(F.count_if(F.col(k)).alias(k) for k in kinds))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))))


def length_profile(rows: DataFrame, group: str, text: str, page: str, seq: str) -> DataFrame:
    """Per group: rows, median, p90 (element at floor(0.9 n)) and longest text, long rows, and steps back in page order.

    p90 is read off a running count over (group, length), not off a sort of the group in one task.
    """
    long = rows.select(F.col(group).alias("g"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("l"))
    counts = long.groupBy("g", "l").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g").orderBy("l")
    cum = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("l")))
    sums = cum.groupBy("g").agg(
        F.max("n").alias("n_rows"),
        F.round((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2, 6).alias("median_length"),
        at(F.floor(F.col("n") * 0.9)).alias("p90_length"),
        F.max("l").alias("max_length"),
        F.coalesce(F.sum(F.when(F.col("l") > 300, F.col("c"))), F.lit(0)).alias("n_over_300"),
        F.coalesce(F.sum(F.when(F.col("l") > 1000, F.col("c"))), F.lit(0)).alias("n_over_1000"),
    )
    pages = running(rows.select(F.col(group).alias("g"), F.col(seq).alias("s"), F.col(page).alias("p")), ["g"], "s", {"top": ("max", F.col("p"))})
    back = pages.groupBy("g").agg(F.count_if(F.col("p") < F.col("top")).alias("n_behind"))
    return sums.join(back, "g").withColumnRenamed("g", group)


def numbering_gaps(rows: DataFrame, group: str, number: str, expand: bool = False) -> DataFrame:
    """(group, first, last): runs of numbers between the least and the greatest of a group that no row has; expand gives (group, missing), number by number."""
    seen = rows.select(group, F.col(number).cast("int").alias("n")).distinct()
    nexts = seen.withColumn("m", F.lead("n").over(Window.partitionBy(group).orderBy("n")))
    gaps = nexts.filter("m > n + 1").select(group, (F.col("n") + 1).alias("first"), (F.col("m") - 1).alias("last"))
    return gaps.select(group, F.explode(F.sequence("first", "last")).alias("missing")) if expand else gaps


def usage(calls: DataFrame, model: str, tokens_in: Column, tokens_out: Column, prices: list[tuple[str, float, float]], default: tuple[float, float] = (3.0, 12.0)) -> DataFrame:
    """Per model: calls, tokens, and cost by the first price whose key is in the model's name (per million tokens)."""
    price_in, price_out = F.lit(default[0]), F.lit(default[1])
    for key, a, b in reversed(prices):
        price_in, price_out = F.when(F.col(model).contains(key), a).otherwise(price_in), F.when(F.col(model).contains(key), b).otherwise(price_out)
    sums = calls.groupBy(model).agg(F.count("*").alias("n_calls"), F.sum(tokens_in).cast("long").alias("tokens_in"), F.sum(tokens_out).cast("long").alias("tokens_out"))
    return sums.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 4))


def filled_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns in which some row has more than blanks: one aggregation to one row, then a static select."""
    row = df.agg(*(F.max(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]
