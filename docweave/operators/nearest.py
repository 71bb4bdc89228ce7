"""Exact cosine top-k of many queries: matrix products find candidates, which are scored as `text.cosine` does.

Queries are broadcast in shards of a bounded size; every vector passes every shard. A product in single precision is off by
a bounded error, so a vector that comes within that error (and the rounding of scores) of a query's k-th best is kept and
scored in double precision. Equal vectors of a chunk are one, with as many of its smallest ids as can be among the k best,
so a large group of copies is not compared row by row.

Defined cases: a vector that is null, or has a null in it, counts as zero, and zero has cosine 0 with all; a norm that is
no finite number gives NaN, which ranks first. Vectors of different lengths are an error, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.search import top_k

#: Numbers in a shard of queries.
SHARD = 8_000_000
#: Vectors of a chunk; of a slab and queries of a block, whose product is one matrix; vectors of the first slab.
CHUNK, SLAB, BLOCK, FIRST = 65_536, 2048, 512, 256


def matrix(vectors: pa.Array) -> np.ndarray:
    """One row a vector, in double precision; what is null, or has a null, is zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    lengths = np.unique(sizes[~np.isnan(sizes)] if sizes.dtype.kind == "f" else sizes)
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {lengths[:5].astype(int).tolist()}")
    d = int(lengths[0]) if len(lengths) else 0
    out = np.zeros((len(vectors), d))
    if d:
        flat = vectors.flatten()
        rows = flat.to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
        if flat.null_count:
            rows[flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)] = 0
        out[vectors.is_valid().to_numpy(zero_copy_only=False)] = rows
    return out


def norms(m: np.ndarray) -> np.ndarray:
    """Summed in order, as `text.dot` does."""
    total = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for k in range(m.shape[1]):
            total += m[:, k] * m[:, k]
        n = np.sqrt(total)
    return np.where(n == 0, 1.0, n)


def unit(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        u = (m / n[:, None]).astype(np.float32)
    u[~np.isfinite(n)] = 0
    return u


def scored(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, operation by operation as in `text.cosine`."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
        return total / (na * nb)


class Scan:
    """The state of one pass over some vectors: per query the k best products so far, and what is near the last of these."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k, self.n = ids, q, k, norms(q)
        self.flat = ~np.isfinite(self.n) | ~q.any(axis=1)  # all vectors are as good
        order = np.flatnonzero(~self.flat)
        self.live, self.u = order, unit(q[order], self.n[order])
        self.best = np.full((len(order), k), -np.inf, np.float32)
        self.least = np.full(len(order), -np.inf, np.float32)
        self.margin = np.float32(4 * (q.shape[1] + 8) * 2.0**-24 + 2e-6)

    def kept(self, group: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best of their group without one id: k + 1 smallest ids, k rows of each."""
        rows = pd.DataFrame({"g": group, "d": docs, "row": np.arange(len(docs))}).sort_values(["g", "d", "row"])
        of = rows.groupby(["g", "d"], sort=False).cumcount().to_numpy()
        first = (of == 0).astype(np.int64)
        place = first.cumsum()
        start = pd.Series(place).groupby(rows["g"].to_numpy()).transform("min").to_numpy()
        return rows["row"].to_numpy()[(of < self.k) & (place - start <= self.k)]

    def chunk(self, docs: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, doc, score) of what can be among the k best."""
        if m.shape[1] != self.q.shape[1] and m.shape[1] and self.q.shape[1]:
            raise ValueError(f"vectors have different lengths: {m.shape[1]} and {self.q.shape[1]}")
        if m.shape[1] != self.q.shape[1]:
            m = np.zeros((len(m), self.q.shape[1])) if not m.shape[1] else m
        n = norms(m)
        odd = ~np.isfinite(n)
        m = np.where(odd[:, None], np.nan, m + 0.0)
        _, lead, group = np.unique(np.ascontiguousarray(m).view(f"V{8 * max(1, m.shape[1])}").ravel() if m.shape[1] else np.zeros(len(m)), return_index=True, return_inverse=True)
        rows = self.kept(group, docs)
        members = pd.DataFrame({"g": group[rows], "doc": docs[rows]})
        v, nv, bad = m[lead], n[lead], odd[lead]
        places, groups = self.near(unit(v, nv), bad, members) if len(self.live) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        score = np.zeros(len(places))
        for at in range(0, len(places), 1 << 18):
            p, g = places[at : at + (1 << 18)], groups[at : at + (1 << 18)]
            score[at : at + (1 << 18)] = scored(v[g], nv[g], self.q[p], self.n[p])
        found = pd.DataFrame({"p": places, "g": groups, "s": score}).merge(members, on="g")
        parts = [found[["p", "doc", "s"]]]
        if self.flat.any():
            some = pd.DataFrame({"doc": docs, "bad": odd}).iloc[self.kept(odd.astype(np.int64), docs)]
            every = pd.DataFrame({"p": np.flatnonzero(self.flat)}).merge(some, how="cross")
            every["s"] = np.where(every["bad"] | ~np.isfinite(self.n[every["p"]]), np.nan, 0.0)
            parts.append(every[["p", "doc", "s"]])
        out = pd.concat(parts)
        p, doc = out["p"].to_numpy(np.int64), out["doc"].to_numpy(np.int64)
        other = self.ids[p] != doc
        return p[other], doc[other], out["s"].to_numpy(np.float64)[other]

    def near(self, u: np.ndarray, bad: np.ndarray, members: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, group) of the products within the margin of the k best."""
        alone = members.groupby("g")["doc"].agg(["min", "max"])
        alone = alone[alone["min"] == alone["max"]].reset_index()[["g", "min"]].rename(columns={"min": "id"})
        own = pd.DataFrame({"id": self.ids[self.live], "p": np.arange(len(self.live))}).merge(alone, on="id").sort_values("g")
        own_p, own_g = own["p"].to_numpy(), own["g"].to_numpy()
        edges = [0, *range(min(FIRST, len(u)), len(u), SLAB), len(u)]
        found_p, found_g, found_s = [], [], []
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            right, is_bad = u[lo:hi].T, np.flatnonzero(bad[lo:hi])
            own_here = slice(*np.searchsorted(own_g, [lo, hi]))
            here_p, here_g = own_p[own_here], own_g[own_here] - lo
            for at in range(0, len(self.live), BLOCK):
                s = self.u[at : at + BLOCK] @ right
                if len(is_bad):
                    s[:, is_bad] = 2  # NaN is above all
                mine = (here_p >= at) & (here_p < at + len(s))
                if mine.any():
                    s[here_p[mine] - at, here_g[mine]] = -np.inf
                least, best = self.least[at : at + BLOCK], self.best[at : at + BLOCK]
                if np.isneginf(best).any():
                    merged = np.concatenate([best, s], axis=1)
                    best[:] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k :]
                    least[:] = best.min(axis=1) - self.margin
                    hit = np.flatnonzero((s >= least[:, None]) & (s > -np.inf))
                    if not len(hit):
                        continue
                    p, g = np.divmod(hit, s.shape[1])
                    values = s.ravel()[hit]
                else:
                    hit = np.flatnonzero(s >= least[:, None])
                    if not len(hit):
                        continue
                    p, g = np.divmod(hit, s.shape[1])
                    values = s.ravel()[hit]
                    order = np.lexsort((-values, p))
                    sorted_p = p[order]
                    starts = np.flatnonzero(np.r_[True, sorted_p[1:] != sorted_p[:-1]])
                    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
                    touched = sorted_p[starts]
                    line = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
                    more = np.full((len(touched), self.k), -np.inf, np.float32)
                    top = rank < self.k
                    more[line[top], rank[top]] = values[order][top]
                    best[touched] = np.partition(np.concatenate([best[touched], more], axis=1), self.k, axis=1)[:, -self.k :]
                    least[touched] = best[touched].min(axis=1) - self.margin
                stay = values >= least[p]
                found_p.append(p[stay] + at)
                found_g.append(g[stay] + lo)
                found_s.append(values[stay])
        if not found_p:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, g, s = map(np.concatenate, (found_p, found_g, found_s))
        stay = s >= self.least[p]
        return self.live[p[stay]], g[stay]


def cosine_top(vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best vectors of each query but those of its own id, ties by doc. Ids are whole numbers."""
    spark = vectors.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("query"), F.col(query_vec).alias("qv")).filter("query IS NOT NULL")
    count, longest = q.agg(F.count("*"), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    shards = max(1, -(-count * max(1, longest) // SHARD))
    docs = vectors.select(F.col(vec_id).cast("long").alias("doc"), F.col(vec).alias("v")).filter("doc IS NOT NULL")
    docs = docs.repartition(3 * spark.sparkContext.defaultParallelism, "doc")  # one file can be one split

    def passed(shard: int) -> DataFrame:
        table = q.filter(F.pmod(F.xxhash64("query"), F.lit(shards)) == shard).toArrow()
        kind = table.schema.field("qv").type.value_type.to_pandas_dtype()
        held = spark.sparkContext.broadcast((table["query"].to_numpy(), matrix(table["qv"]).astype(kind)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, values = held.value
            state, some, n = Scan(ids, values.astype(np.float64), k), [], 0

            def found() -> pa.RecordBatch:
                chunk = pa.Table.from_batches(some)
                p, doc, score = state.chunk(chunk["doc"].to_numpy(), matrix(chunk["v"]))
                return pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(doc), pa.array(score, from_pandas=False)], names=["query", "doc", "score"])

            for batch in batches:
                some.append(batch)
                n += batch.num_rows
                if n >= CHUNK:
                    yield found()
                    some, n = [], 0
            if n and len(ids):
                yield found()

        return docs.mapInArrow(scan, "query long, doc long, score double")

    out = passed(0)
    for shard in range(1, shards):
        out = out.unionByName(passed(shard))
    return top_k(out.withColumn("score", F.round("score", 6)), "query", "score", "doc", k)
