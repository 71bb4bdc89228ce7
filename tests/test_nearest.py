"""Exact cosine top-k by matrix products, against every pair scored."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.operators import nearest, search

SCHEMA = "vec_id long, embedding array<float>"


def odd_rows(n=900, d=6):
    """Vectors with copies, multiples, near ties, zero, null, not finite, and ids that repeat."""
    rng = random.Random(3)
    some = [[rng.choice([-1.0, 0.0, 0.5, 1.0, rng.random()]) for _ in range(d)] for _ in range(60)]
    rows = [(i, [x * rng.choice([1, 1, 2, 3]) for x in rng.choice(some)] if rng.random() < 0.6 else [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    rows[:300] = [(i, [1.0] * d) for i in range(300)]
    rows += [(100, [1.0, 1.0, 1.0, 1.0, 1.0, 0.5])] * 7 + [(400, None), (401, None), (450, [0.0] * d), (None, [1.0] * d), (450, [1.0] * d)]
    return rows


def pairs(spark, rows, k):
    e = spark.createDataFrame(rows, SCHEMA)
    v = e.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 6)))
    q = e.filter("vec_id % 50 = 0")
    want = search.top_k(search.cosine_scores(v, "vec_id", "embedding", v.filter("vec_id % 50 = 0"), "vec_id", "embedding"), "query", "score", "doc", k)
    got = nearest.cosine_top(e, "vec_id", "embedding", q, "vec_id", "embedding", k)
    return tuple(sorted(map(str, (tuple(r) for r in x.select("query", "doc", "score", "rank").collect()))) for x in (got, want))


@pytest.mark.parametrize("k", [1, 5])
def test_odd_vectors_as_all_pairs(spark, k):
    got, want = pairs(spark, odd_rows(), k)
    assert got == want and len(got) > 15


def test_not_finite_ranks_first(spark):
    rows = [(i, [float(i % 7), 1.0, 0.5, 0.0, 0.0, 0.0]) for i in range(200)] + [(777, [float("nan")] + [1.0] * 5), (150, [float("inf")] * 6), (778, [float("inf")] + [0.0] * 5)]
    got, want = pairs(spark, rows, 5)
    assert got == want and any("nan" in x for x in got)


def test_small_chunks_and_blocks(monkeypatch):
    for name, value in (("SLAB", 7), ("BLOCK", 3), ("FIRST", 4)):
        monkeypatch.setattr(nearest, name, value)
    rows = [r for r in odd_rows(400) if r[0] is not None]
    ids = np.array([r[0] for r in rows])
    m = nearest.matrix(pa.array([r[1] for r in rows], pa.list_(pa.float32())))
    at = np.flatnonzero(ids % 50 == 0)
    scan = nearest.Scan(ids[at], m[at], 5)
    found = [scan.chunk(ids[lo : lo + 90], m[lo : lo + 90]) for lo in range(0, len(ids), 90)]
    p, doc, score = map(np.concatenate, zip(*found))
    assert len(p) < len(at) * len(ids) / 4
    n = nearest.norms(m)
    for i, row in enumerate(at):
        every = nearest.scored(m, n, np.repeat(m[[row]], len(m), 0), np.repeat(n[[row]], len(m)))
        want = sorted((-round(s, 6), d) for s, d in zip(every, ids) if d != ids[row])[:5]
        assert sorted((-round(s, 6), d) for s, d in zip(score[p == i], doc[p == i]))[:5] == want


def test_lengths_that_differ_are_an_error():
    with pytest.raises(ValueError, match="different lengths"):
        nearest.matrix(pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float32())))


def test_query_goes_by_products(spark, sf):
    from docweave.plans import registry

    plan = registry.queries()["cosine_top5"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
