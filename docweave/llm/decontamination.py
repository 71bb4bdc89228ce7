"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage.

Items are ordered by length and cut into blocks; a posting list knows, per block, the highest impact in it. A passage
(a window of words, moved by half its length) is a query. Impacts are BM25 contributions as a share of the item's score
for its own text, so one threshold fits all items. First, per passage, the sums of block maxima are taken for all blocks
at once and blocks that cannot reach the threshold are skipped; then the remaining blocks are walked document at a time
with WAND: lists are kept in order of their next item, and the walk jumps to the first item whose lists' bounds can reach
the threshold. Every item at or above the threshold is returned; there is no top-k. A hit counts once the item's question
and its answer (its last sentence; of a single sentence, the last third) both overlap the document.

Equal texts are one item of the index, and matches are joined to all ids that have the text. An index holds a shard of
the items: shards are cut by a hash, into as many as it takes for each to have SHARD_CHARS characters at most (or one
longer item), which bounds what is broadcast. AT_ONCE shards are searched in one pass over the documents. Number of items,
document frequencies, mean length and passage length are those of the whole benchmark, so scores do not depend on shards.

Defined cases: null or empty texts match nothing, on either side; items without words are never found; rows of the same
id and text are one item; null ids stay null; texts of any length are searched whole, passage by passage; repeated
document rows are searched row by row; an empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import free_name, staged

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Share of the 3-word runs of the question, and of the answer, that the document must have.
OVERLAP = 0.5
RUN = 3
#: Least words of a passage; it is as long as the longest item, if that is longer.
PASSAGE = 64
BLOCKS = 64
SHARD_CHARS = 500_000
AT_ONCE = 4

#: ASCII but letters and digits becomes a space.
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

HITS = "array<struct<k1:bigint,k2:bigint,score:double,question:double,answer:double,at:int>>"


def terms(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; all of non-ASCII counts as letters."""
    return text.lower().encode().translate(FOLD).split() if text else []


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item."""
    sentences = [x for x in map(terms, re.split(r"(?<=[.!?])\s+|\n", text)) if x]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def runs(words: list[bytes], n: int = RUN) -> set[tuple[bytes, ...]]:
    n = max(1, min(n, len(words)))
    return set(zip(*(words[i:] for i in range(n)))) if words else set()


@dataclass(frozen=True)
class Stats:
    """Of the whole benchmark: items with words, their mean and greatest length, and in how many of them a term is."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]


def statistics(lengths: list[int], distinct_terms: list[set[bytes]]) -> Stats:
    return Stats(len(lengths), sum(lengths) / max(1, len(lengths)), max(lengths, default=0), Counter(t for x in distinct_terms for t in x))


class Index:
    """items: (id, text). Items without words are left out. Without stats the items are the whole benchmark."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, stats: Stats | None = None):
        kept = sorted(((len(w), str(i), i, t, w) for i, t in items if (w := terms(t))), key=lambda x: x[:2])
        self.ids = [x[2] for x in kept]
        self.threshold = threshold
        stats = stats or statistics([x[0] for x in kept], [set(x[4]) for x in kept])
        self.window = max(PASSAGE, stats.longest)
        self.sides = [tuple(map(runs, parts(x[3]))) for x in kept]
        self.block = max(1, -(-len(kept) // BLOCKS))
        n, mean, df = stats.n, stats.mean, stats.df
        own_terms = sorted({t for x in kept for t in x[4]})
        self.vocabulary = {t: i for i, t in enumerate(own_terms)}
        impacts: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (length, _, _, _, words) in enumerate(kept):
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in Counter(words).items()}
            own = sum(weight.values())
            for t, w in weight.items():
                impacts[self.vocabulary[t]].append((k, w / own))
        self.bounds = np.zeros((len(own_terms) + 1, -(-len(kept) // self.block)), np.float32)  # the last row: terms not in the index
        self.postings: list[list[tuple[list[int], list[float]]]] = []
        for t in range(len(own_terms)):
            lists: dict[int, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
            for k, w in impacts[t]:
                items_, weights_ = lists[k // self.block]
                items_.append(k)
                weights_.append(w)
                self.bounds[t, k // self.block] = max(self.bounds[t, k // self.block], np.nextafter(np.float32(w), np.float32(2)))
            self.postings.append(dict(lists))

    def walk(self, block: int, query: list[int]) -> list[tuple[int, float]]:
        """WAND within a block: (item, score) of all items at or above the threshold."""
        found = []
        lists = [[items[0], 0, items, weights, float(self.bounds[t, block])] for t in query if (p := self.postings[t].get(block)) for items, weights in [p]]
        least = self.threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, None
            for x in lists:
                total += x[4]
                if total >= least:
                    pivot = x[0]
                    break
            if pivot is None:
                break
            if lists[0][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[0] != pivot:
                        break
                    score += x[3][x[1]]
                    x[1] += 1
                if score >= least:
                    found.append((pivot, score))
            else:
                for x in lists:
                    if x[0] >= pivot:
                        break
                    while x[1] < len(x[2]) and x[2][x[1]] < pivot:
                        x[1] += 1
            lists = [x for x in lists if x[1] < len(x[2])]
            for x in lists:
                x[0] = x[2][x[1]]
        return found

    def search(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item number, score, question overlap, answer overlap, first word of the best passage) of what the text contains."""
        words = terms(text)
        if not words or not self.ids:
            return []
        none, get = len(self.vocabulary), self.vocabulary.get
        at = np.fromiter((get(w, none) for w in words), np.int32, len(words))
        step = self.window // 2
        known = np.flatnonzero(at != none)
        if not len(known):
            return []
        starts = np.arange(0, max(1, len(words) - step), step)
        # Sums of bounds over a window, repeated words counted again: never less than the true bound.
        lo, hi = np.searchsorted(known, starts), np.searchsorted(known, starts + self.window)
        best: dict[int, tuple[float, int]] = {}
        for first in range(0, len(starts), 512):
            a, b = lo[first : first + 512], hi[first : first + 512]
            sums = np.zeros((b[-1] - a[0] + 1, self.bounds.shape[1]))
            np.cumsum(self.bounds[at[known[a[0] : b[-1]]]], axis=0, out=sums[1:])
            rows, blocks = np.nonzero(sums[b - a[0]] - sums[a - a[0]] >= self.threshold - 1e-3)
            last, query = -1, np.zeros(0, np.int32)
            for row, block in zip(rows.tolist(), blocks.tolist()):
                if row != last:
                    last, query = row, np.unique(at[known[a[row] : b[row]]])
                if self.bounds[query, block].sum() < self.threshold - 1e-3:
                    continue
                for item, score in self.walk(block, query.tolist()):
                    if score > best.get(item, (0.0, 0))[0]:
                        best[item] = (score, int(starts[first + row]))
        if not best:
            return []
        own: dict[int, set] = {}
        hits = []
        for item, (score, start) in sorted(best.items()):
            overlap = []
            for side in self.sides[item]:
                n = len(next(iter(side), ()))
                if n and n not in own:
                    own[n] = runs(words, n) if len(words) >= n else set()
                overlap.append(len(side & own[n]) / len(side) if n else 1.0)
            if min(overlap) >= OVERLAP:
                hits.append((item, score, *overlap, start))
        return hits


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_lists(texts: pd.Series) -> pd.Series:
    return pd.Series([[w.decode() for w in terms(t)] for t in texts], dtype=object)


def keyed(benchmark: DataFrame, text_col: str) -> DataFrame:
    """benchmark's rows with a text, and its key (k1, k2)."""
    text = F.col(f"`{text_col}`")
    return benchmark.filter(text.isNotNull()).withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))


def shards(benchmark: DataFrame, text_col: str, threshold: float, shard_chars: int) -> Iterator[Index]:
    """Indexes over disjoint shares of the distinct texts, one after the other."""
    items = keyed(benchmark.select(text_col), text_col).select("k1", "k2", F.col(text_col).alias("text")).dropDuplicates(["k1", "k2"])
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= shard_chars:
        yield Index([((r["k1"], r["k2"]), r["text"]) for r in items.collect()], threshold)
        return
    made = staged(items.withColumn("words", word_lists("text")).filter(F.size("words") > 0), "items")
    n = 2 * -(-chars // shard_chars)
    while True:
        share = F.pmod(F.col("k1"), F.lit(n))
        most = made.groupBy(share.alias("share")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("items")).filter("items > 1").agg(F.max("chars")).first()[0]
        if most is None or most <= shard_chars:
            break
        n *= 2
    whole = made.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    each = made.select("k1", "k2", F.explode(F.array_distinct("words")).alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    with_df = each.join(df, "word").groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "df")).alias("dfs"))  # as many as the item has words
    ready = staged(made.select("k1", "k2", "text").join(with_df, ["k1", "k2"]).withColumn("share", share), "shards")
    for r in range(n):
        rows = ready.filter(F.col("share") == r).collect()  # SHARD_CHARS characters at most
        if rows:
            seen = {x["word"].encode(): x["df"] for row in rows for x in row["dfs"]}
            yield Index([((x["k1"], x["k2"]), x["text"]) for x in rows], threshold, Stats(whole["n"], whole["words"] / whole["n"], whole["longest"], seen))


def passes(spark, benchmark: DataFrame, text_col: str, threshold: float, shard_chars: int) -> Iterator[list]:
    """Broadcast indexes for one pass over the documents, AT_ONCE at a time."""
    some = []
    for index in shards(benchmark, text_col, threshold, shard_chars):
        some.append(spark.sparkContext.broadcast(index))
        if len(some) == AT_ONCE:
            yield some
            some = []
    if some:
        yield some


def hits_udf(sent: list):
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        indexes = [s.value for s in sent]
        return pd.Series([[dict(zip(("k1", "k2", "score", "question", "answer", "at"), (*x.ids[i], *h))) for x in indexes for i, *h in x.search(t)] for t in texts], dtype=object)

    return hits.asNondeterministic()  # else a filter on the number of hits is derived, and texts are searched twice


def leaks_udf(sent: list):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        indexes = [s.value for s in sent]
        return pd.Series([any(x.search(t) for x in indexes) for t in texts], dtype=bool)

    return leaks


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap, at_word): one row for each document row and item in it."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, k1 long, k2 long, score double, question double, answer double, at int")
    for sent in passes(spark, benchmark, item_text_col, threshold, shard_chars):
        found = found.unionByName(docs.select(F.col(id_col).alias("id"), hits_udf(sent)(F.col(text_col)).alias("hits")).select("id", F.inline("hits")))
    names = keyed(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "text").select("k1", "k2", "item_id").distinct()
    return found.join(names, ["k1", "k2"]).select(F.col("id").alias(id_col), "item_id", F.round("score", 6).alias("score"), F.round("question", 6).alias("question_overlap"), F.round("answer", 6).alias("answer_overlap"), F.col("at").alias("at_word"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", threshold: float = THRESHOLD, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs without the rows whose text contains an item, with all their columns."""
    kept = docs
    for sent in passes(docs.sparkSession, benchmark, item_text_col, threshold, shard_chars):
        name = free_name(kept, "leaks")
        kept = kept.withColumn(name, leaks_udf(sent)(F.col(f"`{text_col}`"))).filter(~F.col(name)).drop(name)
    return kept
