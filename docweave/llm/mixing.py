"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r: how often its words are taken, MOST at most. Among all rates that meet each source's token
target, and keep each length group's share of all tokens as it is in the corpus, those nearest to 1 in token-weighted
relative entropy are sought. The convex dual has a multiplier for each source and each length group, and its solution tilts
the rates exponentially: r = min(MOST, exp(source's + group's)). Newton iterations solve it. Given the groups' multipliers,
each source's own is found by bisection in its row; gradient and Hessian of what is left are sums over the sources, one
distributed aggregation an iteration, to a single row. The groups' constraints carry a small penalty (RIDGE), so there is
a solution also where the targets leave no room for them; the sources' targets are met exactly.

Rates become whole copies: floor(r) for every document, and one more for some, chosen so that tokens come out right. Each
source's documents are cut into classes of nearly equal size; going from large to small, a class gets as many extra copies
as its tokens ask for, and what rounding leaves over is carried into the next class. Within a class the documents with the
smallest hashes get the extra copy; of rows with the last of these hashes (rows equal in id and text) only as many as it
takes. Hashes are counted before they are ranked, and equal rows numbered by the part of the input they are in, so that
neither a class nor a row that is repeated without end is ever gathered in one task.

Only DataFrame functions are used.

Defined cases: a null text has size 0; documents without words take nothing; sources are ordered by code point, null
last; rows equal in id and text are taken in equal numbers, or some of them once more; a text of any length counts whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import free_name, n_words, numbered, staged

WEIGHTS = (5, 2, 1)
MOST = 3
#: Size classes per doubling of the size.
PER_DOUBLING = 16
#: Words from which the next length group begins; powers of two from 64 on, so that a size class is in one group.
LENGTHS = (128, 1024)
GROUPS = len(LENGTHS) + 1
RIDGE = 1e-3
NEWTON_STEPS, BISECTIONS = 50, 100


def source_key(source: Column) -> Column:
    """Orders like the source by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def size_class(size: Column) -> Column:
    """Exact below 64 words, then PER_DOUBLING classes a doubling."""
    return F.when(size < 64, size.cast("int")).otherwise((F.floor(F.log2(size.cast("double")) * PER_DOUBLING) + 64 - 6 * PER_DOUBLING).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to (skey, source_size): all tokens shared by weight; what a source can't use is shared by weight again.

    A round moves every source that its share fills to its ceiling of most times its size; shares only grow, so the rounds
    end with the first that moves none. Each round is one aggregation to a single row.
    """
    ranked = numbered(sources, ["skey"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight.cast("long")).withColumn("ceiling", F.col("source_size") * most), "sources")
    share, full = None, -1
    while True:
        capped = F.lit(False) if share is None else F.col("ceiling") < F.lit(share) * F.col("weight")
        row = ranked.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(capped, F.col("ceiling"))), F.lit(0)).alias("used"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count_if(capped).alias("full")).first()
        if row["full"] == full or not row["open"]:
            return ranked.withColumn("target", F.least(F.col("ceiling").cast("double"), F.lit(float(share or 0)) * F.col("weight")))
        share, full = (row["all"] - row["used"]) / row["open"], row["full"]


def length_group(klass: Column) -> Column:
    """0 to GROUPS - 1, of a size class."""
    return sum(((klass >= 64 + (n.bit_length() - 1 - 6) * PER_DOUBLING).cast("int") for n in LENGTHS), F.lit(0))


def solved(h: list[list[float]], g: list[float]) -> list[float]:
    """x of h x = g, by elimination with pivots."""
    rows = [[*r, v] for r, v in zip(h, g)]
    n = len(rows)
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(n):
            if i != k:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return [rows[k][n] / rows[k][k] for k in range(n)]


def rates_of(tilt: list[float], most: int) -> list[Column]:
    """Each length group's rate in a row of (tokens, source_size, target), given the groups' multipliers."""
    size, target = F.col("source_size").cast("double"), F.col("target")

    def taken(m: Column) -> Column:
        return reduce(Column.__add__, (F.col(f"tokens_{g}") * F.least(F.lit(float(most)), F.exp(m + F.lit(t))) for g, t in enumerate(tilt)))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        under = taken(middle) < target
        return F.struct(F.when(under, middle).otherwise(state["low"]).alias("low"), F.when(under, state["high"]).otherwise(middle).alias("high"))

    start = F.struct((F.log(target / size) - max(tilt) - 1e-9).alias("low"), F.lit(math.log(most) - min(tilt) + 1e-9).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda state: state["high"])
    return [F.when((size > 0) & (target > 0), F.least(F.lit(float(most)), F.exp(found + F.lit(t)))).otherwise(F.lit(0.0)) for t in tilt]


def exact_sum(value: Column, bits: int) -> Column:
    """Sum in steps of 2 ** -bits, as whole numbers: doubles would sum differently in another order of the rows."""
    return F.sum(F.rint(value * F.lit(2.0**bits)).cast("long")) / F.lit(2.0**bits)


def balanced(sources: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS, close: float = 1e-9) -> DataFrame:
    """Adds rates (one for each length group) to (source_size, target, tokens_0, ...): Newton on the concentrated dual.

    With w the tilted tokens of a source's groups that are under the cap, its part of the Hessian is
    diag(w) - w w' / sum(w); the gradient is what the groups take less what they should. No sum is over most times all
    tokens, so steps as fine as 62 bits allow are used, and the rates don't depend on the order of the rows.
    """
    tokens = [f"tokens_{g}" for g in range(GROUPS)]
    held = sources.agg(*(F.sum(c).alias(c) for c in tokens)).first()
    there = sum(held[c] or 0 for c in tokens)
    bits = 60 - math.ceil(math.log2(most * there + 1))
    total = held.asDict() | {"target": sources.agg(exact_sum(F.col("target"), bits).alias("target")).first()["target"]}
    goal = [(total["target"] or 0.0) * (total[c] or 0) / max(1, there) for c in tokens]
    tilt, ridge = [0.0] * GROUPS, RIDGE * max(1.0, total["target"] or 0.0)
    for _ in range(steps if there else 0):
        got = sources.select("*", *(r.alias(f"rate_{g}") for g, r in enumerate(rates_of(tilt, most))))
        w = [F.when(F.col(f"rate_{g}") < most * (1 - 1e-9), F.col(f"tokens_{g}") * F.col(f"rate_{g}")).otherwise(F.lit(0.0)) for g in range(GROUPS)]
        whole = reduce(Column.__add__, w)
        curve = [exact_sum(F.when(whole > 0, (w[i] if i == j else F.lit(0.0)) - w[i] * w[j] / whole), bits).alias(f"h_{i}_{j}") for i in range(GROUPS) for j in range(GROUPS)]
        row = got.agg(*(exact_sum(F.col(f"tokens_{g}") * F.col(f"rate_{g}"), bits).alias(f"g_{g}") for g in range(GROUPS)), *curve).first()
        gradient = [row[f"g_{g}"] - goal[g] + ridge * tilt[g] for g in range(GROUPS)]
        if max(map(abs, gradient)) <= close * max(1.0, total["target"]):
            break
        hessian = [[(row[f"h_{i}_{j}"] or 0.0) + (ridge if i == j else 0.0) for j in range(GROUPS)] for i in range(GROUPS)]
        move = solved(hessian, gradient)
        damp = min(1.0, 1.0 / max(map(abs, move)))
        tilt = [t - damp * x for t, x in zip(tilt, move)]
    return sources.withColumn("rates", F.array(*rates_of(tilt, most)))


def extras(sizes: DataFrame, rates: DataFrame, most: int = MOST) -> DataFrame:
    """(skey, class, whole, cut, tied): copies all of a class get, and the hash up to which its documents get one more (null: none).

    tied is how many rows with that last hash get it; null if all do.
    """
    counts = staged(sizes.filter("size > 0").groupBy("skey", "class", "range").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "classes")
    classes = counts.groupBy("skey", "class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    classes = classes.join(rates.select("skey", "rates"), "skey").withColumn("rate", F.element_at("rates", length_group(F.col("class")) + 1))
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most)).cast("int")
    part = F.when(F.col("whole") >= most, 0.0).otherwise(F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    classes = classes.withColumn("whole", whole).withColumn("part", part)
    folded = classes.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("minus"), "n", "tokens", "whole", "part"))).alias("cs"))  # as many as there are classes

    def give(state: Column, c: Column) -> Column:
        mean = c["tokens"].cast("double") / c["n"]
        want = c["part"] * c["tokens"] + state["over"]
        extra = F.least(F.greatest(F.round(want / mean), F.lit(0.0)), F.when(c["whole"] >= most, 0.0).otherwise(c["n"].cast("double")))
        return F.struct((want - extra * mean).alias("over"), F.concat(state["given"], F.array(F.struct((-c["minus"]).cast("int").alias("class"), c["whole"].alias("whole"), extra.cast("long").alias("extra")))).alias("given"))

    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<struct<class:int,whole:int,extra:bigint>>").alias("given"))
    given = staged(folded.select("skey", F.inline(F.aggregate("cs", start, give)["given"])), "given")
    by_range = Window.partitionBy("skey", "class").orderBy("range")
    before = counts.select("skey", "class", "range", "n", (F.sum("n").over(by_range) - F.col("n")).alias("before"))
    edge = before.join(given, ["skey", "class"]).filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("n")))
    inside = sizes.filter("size > 0").join(edge.select("skey", "class", "range", (F.col("extra") - F.col("before")).alias("nth")), ["skey", "class", "range"])
    hashes = inside.groupBy("skey", "class", "range", "hash").agg(F.count("*").alias("n"), F.max("nth").alias("nth"))
    upto = F.sum("n").over(Window.partitionBy("skey", "class", "range").orderBy("hash"))
    last = hashes.withColumn("upto", upto).filter((F.col("upto") - F.col("n") < F.col("nth")) & (F.col("nth") <= F.col("upto")))
    cuts = last.select("skey", "class", F.col("hash").alias("cut"), F.when(F.col("nth") < F.col("upto"), F.col("nth") - F.col("upto") + F.col("n")).alias("tied"))
    return given.join(cuts, ["skey", "class"], "left").select("skey", "class", "whole", "cut", "tied")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, label: str = "sizes") -> tuple[DataFrame, DataFrame, bool]:
    """(measured, decisions, any_tied): per row of docs id, size, skey, class and hash; per (skey, class) source_size, target, rates, whole, cut and tied."""
    size = n_words(F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), size.alias("size"), row_hash(id_col, text_col).alias("hash"))
    sizes = staged(sizes.withColumn("class", size_class(F.col("size"))).withColumn("range", F.shiftright("hash", 54).cast("int")), label)
    group = length_group(F.col("class"))
    tokens = [F.sum(F.when(group == g, F.col("size")).otherwise(0)).alias(f"tokens_{g}") for g in range(GROUPS)]
    sources = targets(sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), *tokens), weights, most)
    rates = staged(balanced(staged(sources, "targets"), most), "rates")
    chosen = staged(rates.select("skey", "source_size", "target", "rates").join(extras(sizes, rates, most), "skey", "left"), "mix")
    return sizes, chosen, bool(chosen.filter("tied IS NOT NULL").limit(1).count())


def row_hash(id_col: str, text_col: str) -> Column:
    """Orders the documents of a class."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def numbered_ties(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Numbers rows that are equal in key from 1, part of the input by part, without gathering them."""
    part, u = free_name(rows, "part"), free_name(rows, "u")
    parted = staged(rows.withColumn(part, F.spark_partition_id()).withColumn(u, F.monotonically_increasing_id()), "ties")
    counts = parted.groupBy(*key, part).agg(F.count("*").alias("n"))
    before = counts.select(*key, part, (F.sum("n").over(Window.partitionBy(*key).orderBy(part)) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key, part).orderBy(u))
    return parted.withColumn(u, rank).join(before, [*key, part]).withColumn(name, F.col(u) + F.col("before")).drop(part, u, "before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """id_col, size, source_size, target, rate, copies and taken (size * copies) for every row of docs."""
    sizes, chosen, any_tied = plan(docs, id_col, text_col, source_col, weights, most)
    sources = chosen.groupBy("skey").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("rates").alias("rates"))
    found = sizes.join(chosen.select("skey", "class", "whole", "cut", "tied"), ["skey", "class"], "left")
    more = F.when(F.col("hash") <= F.col("cut"), 1).otherwise(0)
    on_edge = F.col("tied").isNotNull() & (F.col("hash") == F.col("cut"))
    clear = found.filter(~F.coalesce(on_edge, F.lit(False))) if any_tied else found
    out = clear.withColumn("copies", F.coalesce(F.col("whole") + more, F.lit(0)).cast("long"))
    if any_tied:
        tied = numbered_ties(found.filter(on_edge), ["skey", "class"], "place")
        out = out.unionByName(tied.withColumn("copies", (F.col("whole") + (F.col("place") <= F.col("tied")).cast("int")).cast("long")).drop("place"))
    out = out.join(sources, "skey").withColumn("rate", F.when(F.col("size") > 0, F.element_at("rates", length_group(F.col("class")) + 1)).otherwise(F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs as mixed: every row as often as it has copies, with all its columns and copy_no from 1; rows without copies go."""
    _, chosen, any_tied = plan(docs, id_col, text_col, source_col, weights, most)
    skey, klass, hashed, number, made, place = (free_name(docs, x) for x in ("mix_source", "mix_class", "hash", "copy_no", "mix", "place"))
    with_keys = docs.withColumn(skey, source_key(F.col(f"`{source_col}`"))).withColumn(klass, size_class(n_words(F.col(f"`{text_col}`")))).withColumn(hashed, row_hash(id_col, text_col))
    few = chosen.select(F.struct("skey", "class", "whole", "cut", "tied").alias(made))
    joined = with_keys.join(few, (F.col(skey) == F.col(f"{made}.skey")) & (F.col(klass) == F.col(f"{made}.class")))
    on_edge = F.col(f"{made}.tied").isNotNull() & (F.col(hashed) == F.col(f"{made}.cut"))

    def repeated(rows: DataFrame, more: Column) -> DataFrame:
        n = (F.col(f"{made}.whole") + more.cast("int")).cast("int")
        return rows.filter(n > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), n)).alias(number))

    clear = joined.filter(~F.coalesce(on_edge, F.lit(False))) if any_tied else joined
    out = repeated(clear, F.coalesce(F.col(hashed) <= F.col(f"{made}.cut"), F.lit(False)))
    if any_tied:
        tied = numbered_ties(joined.filter(on_edge), [skey, klass], place)
        out = out.unionByName(repeated(tied, F.col(place) <= F.col(f"{made}.tied")))
    return out
