"""How often the operators read their input, and that what they leave out cannot matter."""
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfill.operators import attribution, cluster, distance, knn, sampling, stack, synth
from sparkfill.operators.impute import chained, equations, grouped, strategies


def counting(spark, df, column):
    """``df``, and a count of how often its rows' ``column`` was worked out."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(see, df.schema[column].dataType)(column)), seen


def test_every_pair_score_comes_from_one_count(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), rng.choice("ab"), rng.choice("xyz"), rng.choice("pq")) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, n double, m double, a string, b string, c string")
    twin, seen = counting(spark, df.repartition(1), "a")
    out = {(r.a, r.b): r.score for r in synth.pair_trend_score(df, twin, ["n", "m"], ["a", "b", "c"]).collect()}
    assert len(out) == 10 and all(abs(s - 1) < 1e-12 for s in out.values())
    assert seen.value <= 500


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_ks_is_exact_though_few_values_are_looked_at(spark, monkeypatch, bins):
    rng = random.Random(2)
    a = [rng.gauss(0, 1) for _ in range(1500)] + [math.inf, -math.inf, math.nan, 1e9, None]
    b = [round(rng.gauss(0.2, 1.3), 1) for _ in range(1500)] + [math.inf, math.nan, math.nan, -1e300, 1e300]
    monkeypatch.setattr(synth, "KS_BINS", bins)
    looked, asof = [], distance.asof_prefix
    monkeypatch.setattr(distance, "asof_prefix", lambda points, *rest: looked.append(points.count()) or asof(points, *rest))
    real, twin = (spark.createDataFrame([(x, float(i % 3)) for i, x in enumerate(v)], "v double, w double") for v in (a, b))
    got = {r["column"]: r.score for r in synth.ks_score(real, twin, ["v", "w"]).collect()}

    def order(x):
        return (math.isnan(x), 0.0 if math.isnan(x) else x)

    x, y = ([order(t) for t in v if t is not None] for v in (a, b))
    assert abs(got["v"] - (1 - max(abs(sum(t <= p for t in x) / len(x) - sum(t <= p for t in y) / len(y)) for p in {*x, *y}))) < 1e-12
    assert got["w"] > 0.99
    narrow = [random.Random(3).gauss(0, 1) for _ in range(3000)]
    real, twin = (spark.createDataFrame([(t + s,) for t in narrow], "v double") for s in (0.0, 0.5))
    looked.clear()
    synth.ks_score(real, twin, ["v"]).collect()
    assert bins < 4096 or sum(looked) < 600  # of 6,000


def test_rows_between_the_same_bounds_are_worked_out_once():
    tree = {"feature": 0, "at": 1.0, "left": {"leaf": 0, "value": 1.0}, "right": {
        "feature": 1, "at": 2.0, "left": {"leaf": 1, "value": 4.0}, "right": {"feature": 0, "at": 3.0, "left": {"leaf": 2, "value": 6.0}, "right": {"leaf": 3, "value": 9.0}}}}
    paths = attribution.leaf_paths(tree, {0: 3, 1: 2, 2: 4, 3: 1})
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 4, (2000, 2)), [[1.0, 2.0], [np.nan, 2.0], [3.0, np.nan], [np.inf, -np.inf]]])
    one, place = attribution.cells(paths, x)
    assert len(one) <= 4 * 3
    assert np.allclose(attribution.shapley(paths, x)[1], attribution.shapley(paths, x[one])[1][place], atol=1e-12)


def test_a_race_reads_its_table_twice(spark):
    rng = random.Random(3)
    rows = [(i, float(x := rng.gauss(0, 1)), 2 * x + rng.gauss(0, 0.1)) for i in range(400) for _ in (0,)]
    train, seen = counting(spark, spark.createDataFrame(rows, "key long, v0 double, v1 double").repartition(1), "v0")
    columns = [equations.Variable("a", None), equations.Variable("b", None)]
    out = chained.race(train, columns, 1, {"linear": ("linear", {}), "forest": ("forest", {"numTrees": 2, "maxDepth": 3})}, 1)
    assert sum(r[4] for r in out) == 1 and seen.value <= 2 * 400


def test_a_single_column_is_solved_once(spark, monkeypatch):
    rows = [(i, float(i % 17), None if i % 5 == 0 else 3.0 * (i % 17) + 1, "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, cl string")
    asked, collect = [], equations._collect
    monkeypatch.setattr(equations, "_collect", lambda *a: asked.append(1) or collect(*a))
    filled, report = equations.chained_equations(df, ["x", "y"])
    assert len(asked) == 1
    assert [(r["round"], r.change < 1e-9, r.converged) for r in report.orderBy("round").collect()] == [(1, False, False), (2, True, True)]
    assert all(abs(r.y - 3 * r.x - 1) < 1e-6 for r in filled.collect())
    written, write = [], grouped.written
    monkeypatch.setattr(grouped, "written", lambda *a: written.append(1) or write(*a))
    assert all(abs(r.y - 3 * r.x - 1) < 1e-6 for r in grouped.chained_by_cluster(df, "row_id", "cl", ["y", "x"]).collect())
    assert len(written) == 2


def test_donors_meet_only_where_somebody_asks(spark, monkeypatch):
    rows = [(i, "large" if i < 200 else "small", float(i), None if i % 7 == 0 else float(i)) for i in range(230)]
    df = spark.createDataFrame(rows, "row_id long, cl string, x double, y double")
    seen, join = [], knn.knn_join
    monkeypatch.setattr(knn, "knn_join", lambda q, c, *a, **o: seen.append(c.count()) or join(q, c, *a, **o))
    some = distance.knn_fill(df, "row_id", "cl", "y", ["x"], only=F.col("cl") == "small")
    assert some.where("cl = 'small' and y is null").count() == 0 and some.where("cl = 'large' and y is null").count() == 29
    assert seen == [sum(r[1] == "small" and r[3] is not None for r in rows)]
    assert distance.knn_fill(df, "row_id", "cl", "y", ["x"], only=F.lit(False)).where("y is null").count() == 33 and len(seen) == 1


def test_masks_are_drawn_once(spark):
    rows = [(i, float(i % 4), None if i % 9 == 0 else float(i)) for i in range(900)]
    df, seen = counting(spark, spark.createDataFrame(rows, "row_id long, x double, y double").repartition(1), "y")
    masked, hidden = sampling.mask_random(df, "y", "s")
    n, before = hidden.count(), seen.value
    assert hidden.count() == n and seen.value == before
    strategies.benchmark_imputers(df, "row_id", "y", ["mean"], [(("x",), None, False)] * 4, [0], ["x"]).collect()
    assert seen.value - before <= 8 * 900


def test_sums_of_clusters_keep_ties_and_far_values(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1e200, 0.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    (centres, _), = cluster.lloyd_side_by_side(df, {2: x[:2].copy()}, 0).values()
    assert centres.tolist() == x[:2].tolist()
    (centres, inertia), = cluster.lloyd_side_by_side(df.limit(3), {2: x[:2].copy()}, 1).values()
    assert centres.tolist() == [[0.5, 0.0], [2.0, 0.0]] and inertia == 0.5


def test_stacker_reads_a_table_of_its_own(spark, monkeypatch):
    from sparkfill.plans import q_models
    rng = random.Random(6)
    names = ["row_id", "district", *q_models.KF, "weight", "true_area", "true_flag", "true_weight", "seg", "prio"]
    rows = [(i, i % 2, *(rng.uniform(0, 9) for _ in q_models.KF), None if i % 8 == 0 else float(i % 50), 1, 0, float(i % 50), "s", "p") for i in range(400)]
    rec = spark.createDataFrame(rows, names)
    monkeypatch.setattr(q_models, "records", lambda *_: rec)
    lab = q_models._stack_train(spark, "")
    assert "Join" not in lab._jdf.queryExecution().optimizedPlan().toString()
    model = stack.fit_stacker(lab, q_models.FEATS3, "truth", categorical=False)
    assert stack.predict(model, lab, q_models.FEATS3).count() == lab.count() > 0


def test_the_neighbours_of_all_scopes_are_sought_at_once(spark, monkeypatch):
    from sparkfill.plans import q_insight
    all_six = threading.Barrier(6, timeout=60)

    def neighbours(obs, feats, same=None, far=False):
        all_six.wait()
        return obs.select("row_id", F.lit(2 if far else 1).alias("value"))

    monkeypatch.setattr(q_insight, "_neighbours", neighbours)
    monkeypatch.setattr(q_insight, "_KEPT", {})
    obs = spark.createDataFrame([(1, None), (2, 1)], "row_id long, flag int")
    got = q_insight._scopes(obs, q_insight._selected(spark, "none", obs)).collect()
    assert [r.asDict() for r in got] == [{"row_id": 1, **{f"{p}_{s}": v for s in ("full", "selected", "cluster") for p, v in (("near", 1), ("far", 2))}}]


def test_terms_of_nearest_groups_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "b", None if i % 2 else i % 4, rng.uniform(0, 9), rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, blk string, code int, x double, c string")
    monkeypatch.setattr(distance, "GROUP_ROWS", 10)
    got = distance.nearest_group_scores(df, "row_id", "blk", "code", ["x"], ["c"])
    assert got.rdd.getNumPartitions() >= 200 * 2 * 2 // 10
    groups = {g: [r for r in rows if r[2] == g] for g in (0, 2)}
    for r in got.collect():
        x, c = rows[r.row_id][3:]
        xs = [m[3] for m in groups[r.cand]]
        near = np.mean(np.abs(np.array(xs) - x)) / (max(*xs, x) - min(*xs, x))
        assert math.isclose(r.score, (near + np.mean([m[4] != c for m in groups[r.cand]])) / 2, rel_tol=1e-9)
    assert got.count() == 400


def test_models_are_fitted_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(chained, "FEW_ROWS", 100)
    rng = random.Random(9)
    rows = [(i, rng.uniform(0, 9), None if i % 5 == 0 else float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double").coalesce(1)
    parts = []

    def choose(train, *_):
        parts.append(train.rdd.getNumPartitions())
        return "linear", {}

    filled, _ = chained.model_chain(df, ["x", "y"], choose, max_rounds=1)
    assert parts == [spark.sparkContext.defaultParallelism] and filled.where("y is null").count() == 0
