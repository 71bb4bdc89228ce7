"""Near-duplicates by the Jaccard similarity of word shingles, exact.

Of n shingles in one fixed order, two sets that are similar share one among the first n - ceil(least n) + 1 of each. The
order is by hash, with shingles that many texts begin with last, so that a common passage does not pair the texts that hold
it. Half as many shingles again are kept of each text, which mostly is enough to leave those out; whole sets are made again
from the text where it is not. For two texts that meet, the shared shingles of their beginnings and the places of these
bound how far the whole sets can agree (`promising`); the few pairs that pass are compared as whole sets. SimHash comes
first: texts whose fingerprints differ in 2 bits or fewer meet at the anchors (`simhash.links`) and are checked, which links
most copies. Two bits lose many texts that are similar, so then each text meets one text of each of its shingles, in some
turns; at last texts of different components meet all others of their shingles. Only components matter, so a large group
of near copies is not compared with itself. Texts of a group that are not similar meet too; there the parity bits of the
whole sets, which differ in no more bits than the sets do in shingles, rule out most pairs before they become rows.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words, and null, are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import staged
from docweave.llm.simhash import SEED, components, links

WIDTH = 5
LEAST = 0.8
#: Shingles that are in the beginnings of more texts than this come last in the order.
HOT = 200
#: Beginnings are kept with so many times their shingles.
SPARE = 1.5
#: Turns in which a text meets one text of each shingle, after SimHash.
TURNS = 2
#: Rows of two numbers that are broadcast at most (some 60 bytes each on the driver); beyond, the join shuffles.
BROADCAST_ROWS = 250_000
#: Links whose components are formed on the driver at most; beyond, in rounds on the executors.
DRIVER_LINKS = 100_000
#: Numbers of 64 parity bits for each text.
PARITIES = 4
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    known = {} if known is None else known
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ hashes[k : k + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of the hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits; each tells whether the hashes that fall to it are odd in number."""
    places = (hashes.view(np.uint64) >> np.uint64(17)) % np.uint64(64 * PARITIES)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=64 * PARITIES) % 2 == 1, bitorder="little").view(np.int64)


def sketches(width: int, least: float | None):
    """UDF: the set's fingerprint and size, and its first shingles by hash: SPARE times its beginning, or all without least.

    With least also sim, the SimHash fingerprint, and bits, the parities.
    """

    @F.pandas_udf("fp long, n int, hs array<bigint>" + (", sim long, bits array<bigint>" if least is not None else ""))
    def sets(texts: pd.Series) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        found = [shingles(t, width, known) for t in texts]
        ends = [len(h) if least is None else math.ceil(SPARE * (len(h) - math.ceil(len(h) * least - 1e-9) + 1)) for h in found]
        prints = [np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64) for h in found]
        out = pd.DataFrame({"fp": prints, "n": [len(h) for h in found], "hs": pd.Series([h[:e] for h, e in zip(found, ends)], dtype=object)})
        if least is not None:
            out["sim"] = np.array([majority(h) for h in found], np.int64)
            out["bits"] = pd.Series([parities(h) for h in found], dtype=object)
        return out

    return sets


def small(df: DataFrame) -> DataFrame:
    """A staged table of keys, marked for a broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def beginning(n: Column, least: float) -> Column:
    return n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1


def ordered(rows: DataFrame, least: float) -> DataFrame:
    """(skey, n, i, h): the beginnings in the final order, of rows (skey, n, known, i, h, late).

    i is a shingle's place by hash; known is how many were looked at. Shingles that none shares have no row but count for
    the places. crowded marks texts whose beginning reaches beyond what is known.
    """
    per = rows.groupBy("skey").agg(F.max("n").alias("n"), F.max("known").alias("known"), F.sort_array(F.collect_set(F.struct("i", "h", "late"))).alias("xs"))  # as many as the text has
    per = per.withColumn("xs", F.transform("xs", lambda x, k: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["late"].alias("late"), k.alias("k"))))
    per = per.withColumn("late", F.filter("xs", lambda x: x["late"])).withColumn("early", F.filter("xs", lambda x: ~x["late"]))
    per = per.withColumn("p", beginning(F.col("n"), least)).withColumn("n_early", F.col("known") - F.size("late"))
    early = F.transform("early", lambda x, j: F.struct((x["i"] - x["k"] + j).cast("int").alias("i"), x["h"].alias("h")))
    late = F.transform("late", lambda x, j: F.struct((F.col("n_early") + j).cast("int").alias("i"), x["h"].alias("h")))
    crowded = (F.col("n_early") < F.col("p")) & (F.col("known") < F.col("n"))
    placed = per.select("skey", "n", crowded.alias("crowded"), F.filter(F.when(crowded, F.slice(early, 1, 0)).otherwise(F.concat(early, late)), lambda x: x["i"] < F.col("p")).alias("xs"))
    return placed


def meetings(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], least: float, hot: int) -> DataFrame:
    """(skey, n, h, i): the texts' beginnings, for shingles that two or more have there (some others may remain)."""
    each = sets.filter("n > 0").select("skey", "n", F.size("hs").alias("known"), F.posexplode("hs").alias("i", "h"))
    shared = staged(each.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1"), "shared_shingles")
    rows = each.join(small(shared), "h").withColumn("late", F.col("texts") > hot)
    placed = staged(ordered(rows, least), "beginnings")
    met = placed.filter("NOT crowded").select("skey", "n", F.inline("xs"))
    crowd = staged(placed.filter("crowded").select("skey"), "crowd")
    if crowd.limit(1).count() == 0:
        return staged(met, "meetings")
    hottest = small(staged(shared.filter(F.col("texts") > hot).select("h", F.lit(True).alias("late")), "hot_shingles"))

    def in_full(keys: DataFrame, label: str) -> DataFrame:
        full = whole(keys).select("skey", "n", F.size("hs").alias("known"), F.posexplode("hs").alias("i", "h"))
        made = ordered(full.join(hottest, "h", "left").withColumn("late", F.coalesce("late", F.lit(False))), least)
        return staged(made.select("skey", "n", F.inline("xs")), label)

    crowded = in_full(crowd, "crowded")
    # A text may have had a shingle alone that a crowded text begins with now.
    new = staged(crowded.select("h").distinct().join(shared.select("h"), "h", "left_anti"), "new_shingles")
    touched = staged(each.join(small(new), "h", "left_semi").select("skey").distinct().join(crowd, "skey", "left_anti"), "touched")
    if touched.limit(1).count():
        crowded = crowded.unionByName(in_full(touched, "touched_sets"))
        met = met.join(touched, "skey", "left_anti")
    return staged(met.unionByName(crowded), "meetings")


def similar(pairs: DataFrame, whole: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar."""
    pairs = staged(pairs, "promising")
    keys = staged(pairs.select(F.col("a").alias("skey")).union(pairs.select("b")).distinct(), "promising_keys")
    few = staged(whole(keys).select("skey", "hs"), "promising_sets")
    both = pairs.join(few.select(F.col("skey").alias("a"), F.col("hs").alias("ha")), "a").join(few.select(F.col("skey").alias("b"), F.col("hs").alias("hb")), "b")
    m = F.size(F.array_intersect("ha", "hb"))
    return both.filter(m >= F.lit(least) * (F.size("ha") + F.size("hb") - m) - 1e-9).select("a", "b")


def similar_prints(sims: DataFrame, whole: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Pairs (a, b) of similar sets, found by SimHash, of a table (skey, sim) without repeats.

    The sets of one fingerprint meet their smallest, and the smallest of two linked fingerprints meet.
    """
    leads = staged(sims.groupBy("sim").agg(F.min("skey").alias("lead")), "leads")
    within = sims.join(leads, "sim").filter("skey > lead").select(F.col("lead").alias("a"), F.col("skey").alias("b"))
    at = lambda c, name: leads.select(F.col("sim").alias(c), F.col("lead").alias(name))
    across = links(leads.select(F.col("sim").alias("fp"))).toDF("sa", "sb").join(at("sa", "la"), "sa").join(at("sb", "lb"), "sb")
    return similar(within.union(across.select(F.least("la", "lb"), F.greatest("la", "lb"))), whole, least)


def linked(edges: DataFrame) -> DataFrame:
    """(node, root) of the edges (a, b): a few are joined up on the driver, many by `components`."""
    few = edges.limit(DRIVER_LINKS + 1).toArrow()
    if few.num_rows > DRIVER_LINKS:
        return components(edges)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(few["a"].to_pylist(), few["b"].to_pylist()):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = list(root)
    made = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})
    return edges.sparkSession.createDataFrame(made)


def promising(met: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that can be similar, of the rows (a, na, ia, b, nb, ib), one for each shingle that both begin with.

    Similar sets share least / (1 + least) of their sizes' sum, which bounds what either has that the other has not. Up to
    the end of the beginning that ends first all shared shingles are known, so what either has there beyond them is its
    own: on the one side its whole beginning, on the other at least the places up to the last shared one.
    """
    seen = met.groupBy("a", "b").agg(F.count("*").alias("m"), *(F.max(c).alias(c) for c in ("ia", "ib", "na", "nb")))
    shared = (F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - 1e-6
    may = lambda of_a, of_b: (of_a - F.col("m") <= F.col("na") - shared) & (of_b - F.col("m") <= F.col("nb") - shared)
    a_first = may(beginning(F.col("na"), least), F.col("ib") + 1)
    b_first = may(F.col("ia") + 1, beginning(F.col("nb"), least))
    return seen.filter(a_first | b_first).select("a", "b")


def roots(sets: DataFrame, least: float = LEAST, hot: int = HOT, whole: Callable[[DataFrame], DataFrame] | None = None, prints: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts that are linked to another one.

    sets has skey, n and hs (sorted, the beginning is enough), and may repeat rows; whole gives (skey, n, hs) with all of hs,
    one row for each skey of a table; without it sets has all of hs. prints has skey, sim and bits, one row for each skey
    (see `sketches`); without it SimHash and the parities are left out, which changes no result.
    """
    if whole is None:
        whole = lambda keys: sets.join(keys, "skey", "left_semi").select("skey", "n", "hs").dropDuplicates(["skey"])
    met = meetings(sets, whole, least, hot)
    # A text all of whose beginning is shared leads in the first turn: what copies were made of, rather than a changed copy.
    weight = met.groupBy("skey").agg((F.count("*") / F.max("n")).alias("weight"))
    rest = staged(met.join(small(staged(weight, "weights")), "skey").withColumn("class", F.col("skey")), "met")
    edges = None if prints is None else staged(similar_prints(prints.select("skey", "sim"), whole, least), "similar")
    found = None if edges is None else linked(edges)
    for turn in range(TURNS + 1):
        if found is not None:
            classes = found.withColumnRenamed("node", "skey").withColumnRenamed("root", "to")
            rest = rest.join(small(staged(classes, "classes")), "skey", "left").withColumn("class", F.coalesce("to", "skey")).drop("to")
            sizes = rest.groupBy("h", "class").count().groupBy("h").agg(F.max(F.struct("count", "class")).alias("most"), F.count("*").alias("classes")).filter("classes > 1")
            rest = staged(rest.drop("major").join(sizes.select("h", F.col("most.class").alias("major")), "h"), "unlinked")
        if turn < TURNS:
            order = F.struct((-F.col("weight") if turn == 0 else F.lit(0.0)).alias("w"), F.xxhash64(F.lit(turn), "skey").alias("o"), "skey", "n", "i", "class")
            # In later turns a text of the shingle's largest class leads.
            order = order if turn == 0 else F.when(F.col("class") == F.col("major"), order)
            lead = rest.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(order).alias("lead")).filter("low < high")
            rows = rest.join(lead, "h").filter(F.col("class") != F.col("lead.class"))
            rows = rows.select(F.col("skey").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("lead.skey").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.i").alias("ib"))
            rows = rows.filter(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)
        else:
            # One side leaves out the largest class of a shingle, so that a group of copies does not meet itself.
            if prints is not None:
                left = small(staged(prints.join(small(staged(rest.select("skey").distinct(), "left")), "skey", "left_semi").select("skey", *(F.get("bits", F.lit(k)).alias(f"p{k}") for k in range(PARITIES))), "parities"))
                rest = rest.join(left, "skey")
            x, y = rest.alias("x"), rest.filter(F.col("class") != F.col("major")).alias("y")
            # Shingles that only one of two similar sets has are (1 - least) / (1 + least) of their sizes' sum at most.
            room = (F.col("x.n") + F.col("y.n")) * F.lit((1 - least) / (1 + least)) + 1e-6
            near = F.abs(F.col("x.i") - F.col("y.i")) + F.abs((F.col("x.n") - F.col("x.i")) - (F.col("y.n") - F.col("y.i"))) <= room
            if prints is not None:
                differ = [F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITIES)]
                near = near & (sum(differ[1:], differ[0]) <= room)
            once = (F.col("x.class") == F.col("x.major")) | (F.col("x.skey") < F.col("y.skey"))
            rows = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.class") != F.col("y.class")) & once & (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9) & near)
            swap = F.col("x.skey") < F.col("y.skey")  # the same text on the same side for all shingles of a pair
            pick = lambda c, first: F.when(swap, F.col(f"x.{c}" if first else f"y.{c}")).otherwise(F.col(f"y.{c}" if first else f"x.{c}"))
            rows = rows.select(*(pick(c, first).alias(name) for first, names in ((True, ("a", "na", "ia")), (False, ("b", "nb", "ib"))) for c, name in zip(("skey", "n", "i"), names)))
        new = staged(similar(promising(rows, least), whole, least), "similar")
        edges = new if edges is None else edges.unionByName(new)
        found = linked(edges)
    return found
