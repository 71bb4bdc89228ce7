"""Ordered-state operators: running numbers, carry-forward, islands, clamps, spans.

Spark rows have no order; every operator takes the column that carries it. Groups that are bounded by nature (a document,
a table) use plain windows; running numbers and running extremes over groups of any size work in two levels, so that no
group has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an integer order column that share a block.
BLOCK = 1 << 16


def running(df: DataFrame, group: list[str], seq: str, aggregates: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """Adds running sums, counts or maxima over (group, seq), in two levels.

    aggregates: name to ("sum" | "max", value). A block holds rows whose integer seq shares seq div block; windows run
    within (group, block), and what earlier blocks hold is aggregated map-side and added. seq decides, ties are peers.
    """
    b = "__block"
    cut = df.withColumn(b, F.floor(F.col(seq) / block))
    for name, (kind, value) in aggregates.items():
        cut = cut.withColumn(f"__v_{name}", value)
    fold = {"sum": F.sum, "max": F.max}
    totals = cut.groupBy(*group, b).agg(*(fold[k](f"__v_{n}").alias(n) for n, (k, _) in aggregates.items()))
    earlier = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, b, *(fold[k](n).over(earlier).alias(f"__b_{n}") for n, (k, _) in aggregates.items()))
    # Null groups are groups too: the join compares them null-safe.
    keys = [*group, b]
    right = before.select(*(F.col(c).alias(f"__k_{c}") for c in keys), *(f"__b_{n}" for n in aggregates))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    here = Window.partitionBy(*keys).orderBy(seq).rangeBetween(Window.unboundedPreceding, 0)
    joined = cut.join(right, on, "left")
    for n, (k, _) in aggregates.items():
        now, was = fold[k](f"__v_{n}").over(here), F.col(f"__b_{n}")
        both = F.coalesce(now + was, now, was) if k == "sum" else F.greatest(now, was)
        joined = joined.withColumn(n, both)
    return joined.drop(b, *(f"__k_{c}" for c in keys), *(f"__b_{n}" for n in aggregates), *(f"__v_{n}" for n in aggregates))


def numbered(df: DataFrame, group: list[str], seq: str, name: str = "n", block: int = BLOCK) -> DataFrame:
    """1-based number of a row in its group by an integer seq that is unique in the group."""
    return running(df, group, seq, {name: ("sum", F.lit(1).cast("long"))}, block)


def codes(df: DataFrame, label: str, seq: str, prefix: Column, name: str = "code") -> DataFrame:
    """`{prefix}-{number:03d}`, numbered per label."""
    made = numbered(df, [label], seq, "__n")
    return made.withColumn(name, F.concat(prefix, F.lit("-"), F.lpad(F.col("__n").cast("string"), F.greatest(F.lit(3), F.length(F.col("__n").cast("string"))), F.lit("0")))).drop("__n")


def fill_down(df: DataFrame, table: list[str], seq: str, levels: list[str]) -> DataFrame:
    """Blank cells take the last value above; a level starts afresh whenever a level to its left changes. Tables fit a task."""
    out, left = df, list(table)
    for level in levels:
        w = Window.partitionBy(*left).orderBy(seq)
        value = F.when(F.trim(F.col(level)) == "", None).otherwise(F.col(level))
        out = out.withColumn(level, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit("")))
        run = f"__run_{level}"
        before = F.lag(level).over(Window.partitionBy(*left).orderBy(seq))
        changed = F.when(before.isNull() | (before != F.col(level)), 1).otherwise(0)
        out = out.withColumn(f"__c_{level}", changed).withColumn(run, F.sum(f"__c_{level}").over(w)).drop(f"__c_{level}")
        left.append(run)
    return out.drop(*(f"__run_{x}" for x in levels))


def carry(df: DataFrame, group: list[str], seq: str, value: Column, name: str, default: str) -> DataFrame:
    """The last valid (non-null) value so far in a group, else the default."""
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(seq)), F.lit(default)))


def carry_gated(df: DataFrame, group: list[str], seq: str, table: str, page: str, top: str, mid: str) -> DataFrame:
    """top and mid are carried over blanks within stretches without a break; a new top resets mid.

    A stretch goes on while the table is the same as in the row before, or the page is equal or the next.
    """
    w = Window.partitionBy(*group).orderBy(seq)
    goes_on = (F.col(table) == F.lag(table).over(w)) | ((F.col(page) - F.lag(page).over(w)).between(0, 1))
    out = df.withColumn("__break", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__stretch", F.sum("__break").over(w))
    inside = Window.partitionBy(*group, "__stretch").orderBy(seq)
    blank = lambda c: F.when(F.trim(F.col(c)) == "", None).otherwise(F.col(c))
    out = out.withColumn("__new", F.when(blank(top).isNotNull(), 1).otherwise(0)).withColumn("__block", F.sum("__new").over(inside))
    under = Window.partitionBy(*group, "__stretch", "__block").orderBy(seq)
    return out.withColumn(mid, F.coalesce(F.last(blank(mid), ignorenulls=True).over(under), F.lit(""))).withColumn(top, F.coalesce(F.last(blank(top), ignorenulls=True).over(inside), F.lit(""))).drop("__break", "__stretch", "__new", "__block")


def islands(df: DataFrame, group: list[str], seq: str, key: str, name: str = "run") -> DataFrame:
    """Number of the run of equal consecutive keys, from 1."""
    w = Window.partitionBy(*group).orderBy(seq)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(w)).drop("__changed")


def joined_rows(df: DataFrame, group: list[str], seq: str, text: str, goes_on: Column, glue: str = " ") -> DataFrame:
    """Rows that go on the row before are appended to it: (group, first seq, text, n_rows)."""
    w = Window.partitionBy(*group).orderBy(seq)
    marked = df.withColumn("__starts", F.when((F.row_number().over(w) > 1) & F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__piece", F.sum("__starts").over(w))
    rows = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return marked.groupBy(*group, "__piece").agg(rows.alias("__r"), F.count("*").alias("n_rows")).select(*group, F.col("__r")[0]["s"].alias(seq), F.array_join(F.transform("__r", lambda x: x["t"]), glue).alias(text), "n_rows")


def interpolated(df: DataFrame, group: list[str], seq: str, value: str) -> DataFrame:
    """Gaps take the last known value; rows before the first known one take that."""
    w = Window.partitionBy(*group).orderBy(seq)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.first(value, ignorenulls=True).over(after)))


def spikes_removed(df: DataFrame, group: list[str], seq: str, value: str) -> DataFrame:
    """A value between two equal neighbours that differ from it takes theirs (all rows are judged by the input)."""
    w = Window.partitionBy(*group).orderBy(seq)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(value, F.when((a == b) & (F.col(value) != a), a).otherwise(F.col(value)))


def clamped(df: DataFrame, group: list[str], seq: str, value: str, name: str) -> DataFrame:
    """Running maximum over an integer seq, for groups of any size."""
    return running(df, group, seq, {name: ("max", F.col(value))})


def spans(df: DataFrame, group: list[str], seq: str, level: str, end_name: str = "end_seq") -> DataFrame:
    """For headings: the seq of the next heading with a level at most as deep (null: to the end).

    Levels are few, so the next row of each level is a window of its own and the end is the least of those.
    """
    w = Window.partitionBy(*group).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col(level) >= k, F.min(F.when(F.col(level) == k, F.col(seq))).over(w)) for k in range(1, 7)]
    return df.withColumn(end_name, F.least(*nexts))
