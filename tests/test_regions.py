"""Neighbours sought in regions (operators/regions.py) against brute force, and what they leave on disk."""
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sparkfill.operators import distance, knn, regions
from tests.test_knn import gower_brute, records


def written_bytes(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    top = os.path.dirname(folder.rstrip("/"))
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_pairs_of_blocks_are_not_kept(spark):
    """A record was written once for each block that it met, and each neighbour as a row."""
    rng = random.Random(1)
    rows = [(i, *(rng.random() for _ in range(4)), rng.choice("ab"), None if i % 3 == 0 else i % 2) for i in range(12_000)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, g string, t int")
    before = written_bytes(spark)
    got = distance.gower_knn(df, df.where("t is null"), "row_id", "t", ["a", "b", "c", "d"], ["g"], 10)
    assert got.where("n_near = 10 and n_far = 10").count() == 4000
    assert written_bytes(spark) - before < 60 * len(rows)


@pytest.mark.parametrize("case", [(700, 5, False, None), (700, 6, True, None), (600, 7, True, "g")])
def test_cut_regions_against_brute_force(spark, monkeypatch, case):
    n, seed, hot, same = case
    rows = records(n, seed, hot)
    rows += [{**rows[0], "row_id": n + i, "x": x, "t": None} for i, x in enumerate((-40.0, 999.0, 25.0))]  # beyond the range of all candidates
    want = gower_brute(rows, {"x", "z"}, 7, same)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, x double, z double, c string, g string, t int")
    monkeypatch.setattr(regions, "REGION", 9)
    monkeypatch.setattr(regions, "SAMPLE", 9)
    monkeypatch.setattr(regions, "QUERIES", 3)
    for far in (False, True):
        got = {}
        for r in distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], ["c", "g"], 7, same=same, far=far).collect():
            got.setdefault(r.row_id, []).append((r.rn, round(r.dist, 9)))
        assert {i: [d for _, d in sorted(v)] for i, v in got.items()} == {i: [d for d, _ in v[far]] for i, v in want.items()}


def test_blocks_serve_what_regions_do_not(spark, monkeypatch):
    rows = records(300, 8)
    want = gower_brute(rows, {"x", "z"}, 5)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, x double, z double, c string, g string, t int")
    monkeypatch.setattr(knn, "KINDS", 2)
    for far in (False, True):
        got = {r.row_id: (r.n, r.total, r.cands) for r in
               distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x", "z"], ["c", "g"], 5, far=far, per_query="cands").collect()}
        value = {r["row_id"]: r["t"] for r in rows}
        assert got.keys() == want.keys()
        assert all(n == len(want[i][far]) and total == sum(value[c] for c in cands) for i, (n, total, cands) in got.items())


@pytest.mark.parametrize("grain", [None, 4])
def test_leaves_miss_nothing(grain):
    """The leaves of a region give what all its candidates give, also for ties and queries beyond the range."""
    rng = np.random.default_rng(3)
    y, x = rng.random((3000, 3)) * [1, 50, 1e6], rng.random((400, 3)) * [1.2, 55, 1e6] - [0.1, 2, 0]
    if grain:
        y, x = (np.floor(v / [1, 50, 1e6] * grain) for v in (y, x))
    one = np.zeros((1, 0), int)
    layout = regions.Layout(["a", "b", "c"], ["a", "b", "c"], 10, "bigint", "int", np.zeros(1), np.zeros(1, int), one, np.zeros(1), np.zeros(1, int), one, np.array([400]),
                            y.min(axis=0)[None], y.max(axis=0)[None], np.zeros(1, int), np.array([3000]), y.min(axis=0)[None], y.max(axis=0)[None])
    ids = rng.permutation(3000)
    region = regions._Region(layout, 0, pa.table({"id": ids, "value": np.zeros(3000, np.int32), **{f"x{j}": y[:, j] for j in range(3)}}))
    whole = layout.values(0, x, np.ascontiguousarray(y.T), np.zeros(0))
    want = [np.lexsort((ids, v))[:10] for v in whole]
    for limit in (np.full(400, np.inf), np.array([v[w[5]] for v, w in zip(whole, want)])):
        found, value, met = region.search(0, x, limit)
        for i in range(400):
            w = [int(ids[j]) for j in want[i] if whole[i, j] <= limit[i]]
            assert region.ids.take(pa.array(found[i][found[i] >= 0])).to_pylist() == w
            assert value[i][: len(w)].tolist() == [whole[i, j] for j in want[i][: len(w)]]
    assert met.mean() < 3000


def test_equal_keys_share_their_neighbours(spark):
    rows = [(i // 2, float(i // 2 % 9), "ab"[i // 2 % 2], None if i // 2 % 3 == 0 else 1) for i in range(80)]  # every record twice
    df = spark.createDataFrame(rows, "row_id long, x double, g string, t int")
    for far in (False, True):
        got = distance.gower_neighbours(df, df.where("t is null"), "row_id", "t", ["x"], ["g"], 4, far=far).groupBy("row_id").agg(F.count("*").alias("n"), F.max("rn").alias("m"))
        assert {(r.n, r.m) for r in got.collect()} == {(4, 4)} and got.count() == 14
