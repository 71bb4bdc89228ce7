"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 1 bit in their low or in their high half. Within a
half of 32 bits the anchors are the words of the perfect (31, 26) Hamming code, times the one free bit: every half lies
within the covering radius 1 of exactly one anchor, its home. A fingerprint is replicated to every anchor within covering
radius plus threshold (1 + 1 bits): 17 anchors a half at most. So of two linked fingerprints the one always meets the
other at that one's home anchor, and only fingerprints that share an anchor are compared.

Anchors that are home to many fingerprints are divided by the other half, in three blocks of bits of which one at least
is equal in a linked pair; this keeps hot anchors exact and small. Equal fingerprints are merged before anything is
replicated, so copies cost nothing beyond their own row.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; repeated rows give
one result row each; a component's id is its smallest non-null doc_id (null only if it has none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import free_name, scratch, staged, swept

SEED = 42
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 16
#: An anchor that is home to more fingerprints than this is divided.
HOT_ANCHOR = 256

LOW31 = (1 << 31) - 1
#: For each bit of the syndrome, the positions 1 to 31 that have it.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
#: Bits of the three blocks of a half.
BLOCKS = ((0, 11), (11, 11), (22, 10))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, unsigned: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    sums, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, AT_ONCE):
        some = words[at : at + AT_ONCE + width - 1]
        hashes = np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(some[i:] for i in range(width)))), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist())


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Signed, as Spark has no unsigned type."""
    return pd.Series([(x - (1 << 64) if x >> 63 else x) for x in map(fingerprint, texts)], dtype="int64")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def half(fp: Column, which: Column) -> Column:
    """Bits 0-31 or 32-63, as a non-negative long."""
    return F.when(which == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def syndrome(word: Column) -> Column:
    out = F.lit(0)
    for j, check in enumerate(CHECKS):
        out = out + F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(check))) % 2, j)
    return out.cast("int")


def anchors(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For a table of distinct fp: (anchor, side, fp) of the homes, and of all anchors within 2 bits of a half."""
    halves = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    halves = halves.withColumn("h", half(F.col("fp"), F.col("side")))
    halves = halves.withColumn("w", F.col("h").bitwiseAND(F.lit(LOW31))).withColumn("free", F.col("h").bitwiseAND(F.lit(1 << 31))).withColumn("s", syndrome(F.col("w")))
    halves = halves.withColumn("home", F.expr("CASE WHEN s = 0 THEN w ELSE w ^ shiftleft(1L, s - 1) END"))

    def named(word: Column, free: Column) -> Column:
        return word.bitwiseOR(free).bitwiseOR(F.shiftleft(F.col("side").cast("long"), 32))

    homes = halves.select(named(F.col("home"), F.col("free")).alias("anchor"), "side", "fp")
    # Two flips i and j lead from a word with syndrome s to a code word where i xor j = s; each pair counts once.
    others = F.expr("transform(filter(sequence(1, 31), i -> s <> 0 AND i <> s AND i < (i ^ s)), i -> w ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
    near = F.concat(
        F.array(named(F.col("home"), F.col("free")), named(F.col("home"), F.col("free").bitwiseXOR(F.lit(1 << 31)))),
        F.transform(others, lambda w: named(w, F.col("free"))),
    )
    replicas = halves.select(F.explode(near).alias("anchor"), "side", "fp")
    return homes, replicas


def links(distinct: DataFrame, most: int = 2, hot: int = HOT_ANCHOR) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in at most 2 bits; each pair once."""
    if not 1 <= most <= 2:
        raise ValueError("the anchors cover 1 or 2 differing bits")
    homes, replicas = anchors(distinct)
    crowded = homes.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor", F.lit(True).alias("crowded"))

    def divided(df: DataFrame) -> DataFrame:
        other = half(F.col("fp"), 1 - F.col("side"))
        blocks = F.array(*(F.lit(k).cast("long") * (1 << 12) + F.shiftrightunsigned(other, at).bitwiseAND(F.lit((1 << n) - 1)) for k, (at, n) in enumerate(BLOCKS)))
        cells = F.when(F.col("crowded"), blocks).otherwise(F.array(F.lit(-1).cast("long")))
        return df.join(crowded, "anchor", "left").select("anchor", "side", "fp", F.explode(cells).alias("cell"))

    x, y = divided(homes).alias("x"), divided(replicas).alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    other = half(differ, 1 - F.col("x.side"))
    met_before = F.lit(False)  # in an earlier block of a divided anchor
    for k, (at, n) in enumerate(BLOCKS[:-1]):
        met_before = met_before | ((F.col("x.cell") >= (k + 1) * (1 << 12)) & (F.shiftrightunsigned(other, at).bitwiseAND(F.lit((1 << n) - 1)) == 0))
    # Pairs a bit further apart can meet too; each pair counts in the half that the pigeonhole names.
    first_half = (F.col("x.side") == 0) == (F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1)
    at_home = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.cell") == F.col("y.cell"))
    return x.join(y, at_home & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(differ) <= most) & first_half & ~met_before).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node it is connected to.

    Alternating large-star and small-star: each round hangs all larger neighbours of a node under its smallest one, then
    all smaller ones; rounds grow with the logarithm of the number of nodes. Each round is written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select("u", "u").distinct())
        mark = tuple(seen)
        both = now.select("v", "u").union(now.select("u", "v")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(low, "n").filter("m > n").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u")))).alias("e")).select("e.v", "e.u").filter("v <> u").distinct()
        now = staged(small, "edges")


def grouped(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints has id_col and fp; adds component_id, the smallest id reachable over links of 2 bits or fewer."""
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    root = components(links(distinct.select("fp")))
    tied = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(tied.join(ids, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id for every row of docs."""
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp")), "prints")
    return grouped(prints, "id").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, least: float | None = None) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest id (null last), then the smallest text hash.

    Linked are fingerprints of shingles of 3 words that differ in 2 bits or fewer; with least, texts whose sets of shingles
    of width words have a Jaccard similarity of least or more, exactly: the fingerprints of these sets give the first links,
    each checked on the whole sets, and near_copies those that fingerprints within 2 bits lose. Of rows that are equal in id and text, one stays.
    """
    spark, key = docs.sparkSession, free_name(docs, "text_key")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    text = F.col(f"`{text_col}`")
    row = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key")]
    with scratch(spark), swept(spark):
        if least is None:
            if width != 3:
                raise ValueError("fingerprints are of 3 words")
            prints = staged(docs.select(*row, fingerprints(text).alias("fp")), "prints")
            distinct = staged(prints.groupBy("fp").agg(F.min(order).alias("least")), "fingerprints")
            root = components(links(distinct.select("fp")))
        else:
            from docweave.llm import near_copies

            prints = staged(docs.select(*row, near_copies.sketches(width, least)(text).alias("s")).select("id", "key", "s.*"), "prints")
            distinct = staged(prints.groupBy("fp").agg(F.min(order).alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bits").alias("bits")), "fingerprints")

            def whole(keys: DataFrame) -> DataFrame:
                """All shingles of one text of each set, from the text again: to keep them all would take more room than the texts."""
                wanted = near_copies.small(keys.withColumnRenamed("skey", "fp"))
                chosen = staged(distinct.join(wanted, "fp", "left_semi").select(F.col("key").alias("text_key")), "text_keys")
                texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(near_copies.small(chosen), "text_key", "left_semi").dropDuplicates(["text_key"])
                return texts.select(near_copies.sketches(width, None)("text").alias("s")).select(F.col("s.fp").alias("skey"), "s.n", "s.hs")

            # One row a set, but for rows equal in id and text.
            first = near_copies.small(distinct.select(F.col("fp").alias("of"), F.col("least.id").alias("of_id"), F.col("least.key").alias("of_key")))
            once = prints.join(first, (F.col("fp") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi")
            sims = distinct.filter("n > 0").select(F.col("fp").alias("skey"), "sim", "bits")
            root = near_copies.roots(once.select(F.col("fp").alias("skey"), "n", "hs"), least, whole=whole, prints=sims)
        best = distinct.join(root, distinct.fp == root.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
        best = staged(best.select(F.col("least.id").alias("best_id"), F.col("least.key").alias("best_key")), "best", keep=True)
        repeats = prints.groupBy("id", "key").count().filter("count > 1").limit(1).count()
    kept = docs.withColumn(key, F.xxhash64(text))
    kept = kept.join(best, F.col(f"`{id_col}`").eqNullSafe(F.col("best_id")) & (F.col(f"`{key}`") == F.col("best_key")), "left_semi")
    if repeats:
        kept = kept.dropDuplicates([id_col, key])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
