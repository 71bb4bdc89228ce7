"""Label dictionaries: canonical spelling, merging, absorption, and what else is decided per group of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.dedup import substring_merge, written
from docweave.operators.order import numbered

OTHER = "기타"


def mapped(label: Column, table: dict[str, str]) -> Column:
    """Looked up in a fixed dictionary; what it does not have stays."""
    if not table:
        return label
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[label], label)


def canonical(rows: DataFrame, label: str, name: str = "canonical", aliases: dict[str, str] | None = None, truncations: dict[str, str] | None = None, coarse: dict[str, str] | None = None, least: float = 0.55) -> DataFrame:
    """rows with the canonical label: white space, aliases, truncations, merging into labels that contain it, absorbing
    labels that occur once into the most similar one that does not (else OTHER), coarse classes.

    All steps run on the dictionary of distinct labels with their counts; rows are joined to it once at the end. Blank and
    null labels are OTHER. Of equally similar labels the first by value wins.
    """
    raw = rows.select(F.col(label).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    fixed = mapped(mapped(F.when(F.coalesce(tx.norm(F.col("raw")), F.lit("")) == "", OTHER).otherwise(tx.norm(F.col("raw"))), aliases or {}), truncations or {})
    words = written(raw.select("raw", "n", fixed.alias("label")))
    counts = words.groupBy("label").agg(F.sum("n").alias("n"))
    usable = counts.filter((F.col("label") != OTHER) & tx.valid_label(F.col("label")))
    merged = substring_merge(usable, "label", "n").select(F.col("label").alias("was"), "merged")
    words = words.join(merged, F.col("label") == F.col("was"), "left").select("raw", "n", F.coalesce("merged", "label").alias("label"))
    counts = written(words.groupBy("label").agg(F.sum("n").alias("n")))
    strong = counts.filter((F.col("n") >= 2) & (F.col("label") != OTHER) & tx.valid_label(F.col("label"))).select(F.col("label").alias("strong"))
    once = counts.filter((F.col("n") < 2) & (F.col("label") != OTHER))
    close = F.round(tx.label_similarity(F.col("label"), F.col("strong")), 6)
    best = once.join(strong, close >= least).groupBy("label").agg(F.min(F.struct((-close).alias("s"), "strong")).alias("b"))
    any_strong = strong.limit(1).count() > 0
    if any_strong:
        target = once.join(best, "label", "left").select(F.col("label").alias("was"), F.coalesce("b.strong", F.lit(OTHER)).alias("target"))
        words = words.join(target, F.col("label") == F.col("was"), "left").select("raw", F.coalesce("target", "label").alias("label"))
    dictionary = words.select(F.col("raw").alias("__raw"), mapped(F.col("label"), coarse or {}).alias(name))
    return rows.join(dictionary, F.col(label).eqNullSafe(F.col("__raw")), "left").drop("__raw")


def tab_key(tab: Column) -> Column:
    """A tab's name without what is in brackets."""
    return tx.norm(F.regexp_replace(tab, r"[(\[{（].*?[)\]}）]", " "))


def consolidated(rows: DataFrame, tab: str, small: int = 2, large: int = 5) -> DataFrame:
    """Tabs of at most `small` rows go into the largest tab of at least `large` rows with the same key (first by name of equals)."""
    sizes = rows.groupBy(tab).agg(F.count("*").alias("n")).withColumn("key", tab_key(F.col(tab)))
    into = sizes.filter((F.col("n") >= large) & (F.col("key") != "")).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(tab).alias("t"))).alias("b")).select("key", F.col("b.t").alias("__into"))
    moves = sizes.filter(F.col("n") <= small).join(into, "key").select(F.col(tab).alias("__from"), "__into")
    return rows.join(moves, F.col(tab) == F.col("__from"), "left").withColumn(tab, F.coalesce("__into", tab)).drop("__from", "__into")


def common_spelling(rows: DataFrame, tab: str, seq: str) -> DataFrame:
    """Tabs equal but for white space take the most frequent spelling, of equals the first seen."""
    key = F.regexp_replace(tab, tx.SPACE, "")
    seen = rows.groupBy(key.alias("__key"), F.col(tab).alias("s")).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = seen.groupBy("__key").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "s")).alias("b")).select("__key", F.col("b.s").alias("__best"))
    return rows.withColumn("__k", key).join(best, F.col("__k") == F.col("__key"), "left").withColumn(tab, F.coalesce("__best", tab)).drop("__k", "__key", "__best")


def even_sample(rows: DataFrame, group: str, seq: str, most: int = 30) -> DataFrame:
    """At most `most` rows of each group at evenly spaced places, first and last included; small groups whole."""
    placed = numbered(rows, [group], seq, "__n")
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__c"))
    last = F.col("__c") - 1
    # Place p is taken if some k of 0 ... most-1 rounds to it: floor(k * last / (most-1) + 1/2) = p - 1.
    k = F.ceil(((F.col("__n") - 1) * 2 - 1) * (most - 1) / (2 * F.greatest(last, F.lit(1))))
    hit = F.floor((2 * F.greatest(k, F.lit(0)) * last + (most - 1)) / (2 * (most - 1))) == F.col("__n") - 1
    return placed.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).filter((F.col("__c") <= most) | hit).drop("__n", "__g", "__c")


def common_prefix(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, prefix): the words that all texts of a group begin with. It is what the least and the greatest text share."""
    w = F.split(F.col(text), " ")
    ends = rows.groupBy(group).agg(F.min(w).alias("a"), F.max(w).alias("b"))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("a"), F.size("b"))), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i)))
    return ends.select(group, F.array_join(F.slice("a", 1, F.coalesce(F.array_min(differs), F.size("a"))), " ").alias("prefix"))


def capped_drop(rows: DataFrame, drop: Column, most: float = 0.25) -> DataFrame:
    """Rows to drop go, unless they are more than `most` of all: then nothing goes."""
    share = rows.agg(F.avg(F.coalesce(drop, F.lit(False)).cast("int")).alias("__share"))
    return rows.crossJoin(F.broadcast(share)).filter((F.col("__share") > most) | ~F.coalesce(drop, F.lit(False))).drop("__share")  # share is one row


def roles(scores: DataFrame, table: str) -> DataFrame:
    """Greedy assignment per table of (role, col, score): highest first, each role and each column once.

    Of equal scores the later role, then the higher column goes first. A table has a few roles by a few columns, which are
    folded in that order; what is taken is kept and looked up in the fold.
    """
    cell = F.struct("score", "role", "col")
    ranked = scores.filter("score > 0").groupBy(table).agg(F.reverse(F.array_sort(F.collect_list(cell))).alias("cells"))
    none = F.slice(F.col("cells"), 1, 0)

    def take(taken: Column, c: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["role"] == c["role"]) | (t["col"] == c["col"]))
        return F.when(free, F.concat(taken, F.array(c))).otherwise(taken)

    return ranked.select(table, F.explode(F.aggregate("cells", none, take)).alias("c")).select(table, "c.role", "c.col")
