import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T
from sparkfill.llm import centroids

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # columns whose names the operators use within
    T.StructField("q", T.StringType()), T.StructField("pivots", T.StringType()), T.StructField("n", T.StringType()), T.StructField("share", T.StringType()),
])


def make(spark, rows):
    return spark.createDataFrame([(i, v, label, "q", "p", "n", "s") for i, v, label in rows], VECTORS)


def brute(rows, k=16, dims=64, scale=64, rounds=3):
    """``(vec_id, vector, cluster, distance)`` sorted, and the centroids, in plain integers."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None]
    cs = [v for _, _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        cs = [[sum(x) // len(x) for x in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == n]) else c for n, c in enumerate(cs)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), cs


def check(spark, rows, **options):
    want, cs = brute(rows, **options)
    got = centroids.digest(make(spark, rows), **options).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    per = {c: sum(d for _, o, d in want if o == c) for c in range(len(cs))}
    for r in got:
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()
    return got


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.05, 6).tolist(), i % 3) for i in range(150)]
    rows += [(5, rows[5][1], 1)] * 40 + [(None, rows[7][1], None), (900, None, 1), (901, [], 1), (902, [1.0] * 5, 1), (903, [math.nan] * 6, 1)]
    rows += [(904, [math.inf] + [0.0] * 5, 1), (905, [None] + [0.0] * 5, 1), (906, [0.25] * 6, 1), (907, [1e6] * 6, 1), (908, [-1e6] * 6, 1)]
    check(spark, rows, k=8, dims=6)
    coarse = [(i, [float(v) for v in rng.integers(-1, 2, 6)], 0) for i in range(200)]  # many ties
    check(spark, coarse, k=8, dims=6, scale=1)


def test_few_equal_or_no_vectors(spark):
    assert len(check(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], k=16, dims=2)) == 2
    assert centroids.digest(make(spark, [(1, None, 0)])).collect() == []
    only_null = make(spark, [(None, [0.0, 1.0], 0)])
    assert centroids.digest(only_null, dims=2).collect() == []
    assert centroids.digest(make(spark, []).limit(0)).columns[0] == "vec_id"


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    check(spark, [(i, rng.normal(0, 1, 4).tolist(), 0) for i in range(100)], k=5, dims=4, rounds=rounds)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (16, 32))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 32))
    pivots = centroids.Pivots(centres)
    moved = centres + rng.integers(-40, 40, centres.shape)
    true = ((x[:, None] - moved[None]) ** 2).sum(-1)
    assert (pivots.bounds(pivots.cached(x), pivots.distances(moved)) <= true).all()
    label, distance, checked = centroids.assign(x, pivots.cached(x), moved, pivots)
    assert (label == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert checked < 1.5 * len(x)  # of 16 distances a vector, all but about one are ruled out
    large = np.full((2, 64), 1 << 26) * np.array([[1], [-1]])
    label, distance, _ = centroids.assign(large, centroids.Pivots(large).cached(large), large[::-1].copy(), centroids.Pivots(large))
    assert label.tolist() == [1, 0] and distance.tolist() == [0, 0]
