"""The pruned k-NN joins against brute force."""
import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sparkfill.operators import distance, knn
from sparkfill.plans import records as records_module

FEATS = ["x", "z", "c", "g"]


def gower_brute(rows, numeric, k, same=None):
    """``rows``: dicts; queries have no ``t``. Lists of (distance, id) of the k nearest and farthest."""
    out = {}
    for q in (r for r in rows if r["t"] is None):
        feats = [f for f in FEATS if q[f] is not None]
        cands = [r for r in rows if r["t"] is not None and all(r[f] is not None for f in feats)]
        if same:
            cands = [r for r in cands if q[same] is not None and r[same] == q[same]]
        if not cands:
            continue
        span = {f: max([r[f] for r in cands] + [q[f]]) - min([r[f] for r in cands] + [q[f]]) for f in feats if f in numeric}
        def dist(r):
            terms = [(abs(r[f] - q[f]) / span[f] if span[f] > 0 else 0.0) if f in numeric else float(r[f] != q[f]) for f in feats]
            return sum(terms) / max(len(terms), 1)
        near = sorted((round(dist(r), 9), r["row_id"]) for r in cands)[:k]
        far = sorted((-round(dist(r), 9), r["row_id"]) for r in cands)[:k]
        out[q["row_id"]] = (near, [(-d, i) for d, i in far])
    return out


def records(n, seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        equal = hot and i % 3 == 0  # a third of all rows agree in everything
        rows.append({
            "row_id": i, "x": 5.0 if equal else rng.choice([None, *(round(rng.random() * 50, 1) for _ in range(8))]),
            "z": 1.0 if equal else float(rng.randrange(6)), "c": "a" if equal else rng.choice(["a", "b", "cc", None]),
            "g": "g" if equal else rng.choice(["g", "h"]), "t": rng.choice([None, 1, 2, 3])})
    return rows


@pytest.mark.parametrize("case", [(300, 1, False, None), (400, 2, True, None), (400, 3, True, "g"), (300, 4, False, "c")])
def test_records_against_brute_force(spark, monkeypatch, case):
    n, seed, hot, same = case
    rows = records(n, seed, hot)
    want = gower_brute(rows, {"x", "z"}, 7, same)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, x double, z double, c string, g string, t int")
    monkeypatch.setattr(distance, "RECORD_BLOCK", 16)
    monkeypatch.setattr(distance, "RECORD_CELL", 8)
    monkeypatch.setattr(knn, "PER_TASK", 100)
    for far in (False, True):
        got = {}
        for r in distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], ["c", "g"], 7, same=same, far=far).collect():
            got.setdefault(r.row_id, []).append((r.rn, r.dist, r.cand, r.value))
        assert got.keys() == want.keys()
        value = {r["row_id"]: r["t"] for r in rows}
        for i, found in got.items():
            found.sort()
            assert [round(d, 9) for _, d, _, _ in found] == [d for d, _ in want[i][far]]
            assert [v for *_, v in found] == [value[c] for _, _, c, _ in found]
            # among equal distances the least keys come first; sums that differ only by rounding are not equal
            assert len({c for _, _, c, _ in found}) == len(found)


def test_ties_go_to_the_lowest_key(spark):
    rows = [(0, 5.0, None)] + [(i, 5.0 + (i % 3), i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "row_id long, x double, t int")
    got = distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x"], [], 5).orderBy("rn").collect()
    assert [r.cand for r in got] == [3, 6, 9, 12, 15]
    got = distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x"], [], 5, far=True).orderBy("rn").collect()
    assert [r.cand for r in got] == [2, 5, 8, 11, 14]


def test_far_blocks_are_left_out(spark):
    rng = random.Random(3)
    rows = [(i, *(rng.random() * 10 for _ in range(2)), rng.choice("abcdefgh"), rng.choice("mnopqrst"), None if i % 5 == 0 else i) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id long, x double, z double, c string, g string, t int")
    near, far = {}, {}
    distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], ["c", "g"], 5, counts=near).count()
    assert near["possible"] == 1200 * 4800 and near["compared"] < 0.2 * near["possible"]
    distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], [], 5, far=True, counts=far).count()
    assert far["compared"] < 0.6 * far["possible"]


def test_few_candidates_are_compared_among_records_with_categories(spark):
    rng = random.Random(4)
    rows = [(i, *(rng.random() * 10 for _ in range(2)), rng.choice("abcd"), None if i % 11 == 0 else rng.choice("mnop"), None if i % 5 == 0 else i) for i in range(6000)]
    rows.append((9000, 500.0, 1.0, "a", "m", None))  # beyond the range of all candidates
    df = spark.createDataFrame(rows, "row_id long, x double, z double, c string, g string, t int")
    for far in (False, True):
        counts = {}
        got = distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], ["c", "g"], 5, far=far, counts=counts)
        assert got.count() == 5 * 1201
        assert counts["compared"] < 0.12 * counts["possible"]


def vectors(n, dims, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (clusters, dims))
    return [(i, [float(x) for x in centres[i % clusters] + rng.normal(0, 0.5, dims)], f"l{i % 2}") for i in range(n)]


def k_brute(rows, k):
    out = {}
    for i, v, label in rows:
        if v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        ds = sorted(math.dist(v, w) for j, w, m in rows if j != i and m == label and w is not None and len(w) == len(v)
                    and all(x is not None and math.isfinite(x) for x in w))
        if len(ds) >= k:
            out[i] = ds[k - 1]
    return out


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 20)
    monkeypatch.setattr(knn, "PER_TASK", 50)
    rows = vectors(400, 6, 12, 0)
    rows += [(1000 + i, rows[0][1], "l0") for i in range(100)]  # equal vectors
    rows += [(2000, None, "l0"), (2001, [], "l0"), (2002, [math.nan] * 6, "l0"), (2003, [math.inf] * 6, "l0"), (2004, [None] * 6, "l0"),
             (2005, [1.0] * 6, None), (2006, [1.0, 2.0], "l1"), (2007, [1e9] * 6, "l1")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for k in (1, 4):
        got = {r.vec_id: r.k_dist for r in distance.k_distance(df, "vec_id", "embedding", k, "label").collect()}
        want = k_brute(rows, k)
        assert got.keys() == want.keys()
        assert all(abs(got[i] - d) < 1e-6 * max(1, d) for i, d in want.items())
    some = distance.k_distance(df, "vec_id", "embedding", 4, "label", queries=df.where("vec_id % 50 = 0")).collect()
    assert {r.vec_id: r.k_dist for r in some} == {i: d for i, d in got.items() if i % 50 == 0}
    assert distance.k_distance(df.limit(0), "vec_id", "embedding", 4, "label").collect() == []


def test_clustered_vectors_are_pruned_and_noise_is_not(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 50)
    df = spark.createDataFrame(vectors(3000, 8, 16, 1), "vec_id long, embedding array<double>, label string")
    counts = {}
    got = distance.k_distance(df, "vec_id", "embedding", 3, "label", counts=counts).count()
    assert got == 3000 and counts["compared"] < 0.4 * counts["possible"]


def test_matrix_products_miss_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 20)) + 1000.0  # far from the origin, where products lose digits
    x[100:] = x[:200] + rng.normal(0, 1e-7, (200, 20))
    metric = knn.euclidean().metric
    table = lambda ids, v: pa.table({"id": pa.array(ids), "vec": pa.array(v.tolist(), pa.list_(pa.float64())), "value": pa.array(np.zeros(len(ids)))})
    best = knn._Best(table(np.arange(300), x), metric, 3)
    for a in range(0, 300, 70):
        best.add(table(np.arange(a, min(300, a + 70)), x[a : a + 70]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    assert np.allclose(best.value.reshape(300, 3), want, rtol=1e-9)


def test_blocks_are_bounded(spark):
    df = spark.range(5000).select(F.lit("a").alias("cl"), F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string").substr(1, 1)).alias("cell"),
                                  F.when(F.col("id") < 2000, 1.0).otherwise(F.col("id").cast("double")).alias("ord"), "id")
    sizes = [r["count"] for r in knn.with_blocks(df, 100).groupBy("cl", "blk").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 160


def test_fill_leaves_out_donors_out_of_reach(spark, monkeypatch):
    """Every donor met every row of its cluster before; nulls, NaN, infinite values and equal distances as by brute force."""
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf")]
    rows = []
    for i in range(3000):
        a, b = (rng.choice(odd) if rng.random() < 0.02 else float(rng.randrange(m)) for m in (20_000, 30))
        rows.append((i, rng.choice(["x", "y", None]), a, b, None if rng.random() < 0.2 else float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "row_id long, cl string, a double, b double, y double")
    monkeypatch.setattr(distance, "KNN_BLOCK", 40)
    met = []
    whole = knn.knn_join
    monkeypatch.setattr(knn, "knn_join", lambda *a, **b: (met.append({}), whole(*a, **b, counts=met[-1]))[1])
    got = {r.row_id: r.y for r in distance.knn_fill(df, "row_id", "cl", "y", ["a", "b"], k=3).collect()}
    mean = sum(r[4] for r in rows if r[4] is not None) / sum(r[4] is not None for r in rows)

    def dist(r, d):
        gaps = [x - y for x, y in zip(r[2:4], d[2:4]) if x is not None and y is not None and not math.isnan(x - y)]
        return math.sqrt(sum(g * g for g in gaps) * 2 / len(gaps)) if gaps else None

    assert len(got) == 3000
    for r in rows:
        if r[4] is None:
            near = sorted((dist(r, d), d[0], d[4]) for d in rows if d[1] == r[1] and d[4] is not None and dist(r, d) is not None)[:3]
            want = sum(n[2] for n in near) / len(near) if near else mean
            assert abs(got[r[0]] - want) < 1e-9
    assert met[0]["compared"] < met[0]["possible"] / 2


def test_near_and_far_records_are_sought_at_once(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    whole = distance.gower_neighbours

    def neighbours(*args, **options):
        both.wait()  # one after the other, the first would wait for ever
        return whole(*args, **options)

    monkeypatch.setattr(distance, "gower_neighbours", neighbours)
    df = spark.createDataFrame([(i, float(i % 7), None if i % 3 == 0 else i) for i in range(30)], "row_id long, x double, t int")
    got = distance.gower_knn(df, df.where("t is null"), "row_id", "t", ["x"], [], 3).collect()
    assert len(got) == 10 and all(r.n_near == r.n_far == 3 for r in got)


def test_the_record_table_is_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(records_module, "FILE_ROWS", 100)
    monkeypatch.setattr(records_module, "_WRITTEN", {})
    rec = records_module.records(spark, "/root/testdata/sf0.001")
    assert len(rec.inputFiles()) >= rec.count() // 100
    assert rec.rdd.getNumPartitions() > 1
