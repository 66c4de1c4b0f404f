"""Elimination with cross-validation, k-means of many k at once, mixed pairs, reports of EM and SoftImpute."""
import random

import numpy as np
from pyspark.sql import functions as F
from sparkfill.operators import cluster, select, synth
from sparkfill.operators.impute import lowrank


def test_elimination_recovers_planted_columns(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.uniform(0, 1) for _ in range(4))) for i in range(400)]
    rows = [(*r, 8 * r[1] + 5 * r[3] + rng.gauss(0, 0.05)) for r in rows]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double")
    selected, ranks, curve = select.rfe_cv(df, "row_id", "y", ["a", "b", "c", "d"], folds=3)
    assert {"a", "c"} <= set(selected)
    got = {r["column"]: r["rank"] for r in ranks.collect()}
    assert all(got[c] == 1 for c in selected)
    assert sorted(v for v in got.values() if v > 1) == list(range(2, 2 + 4 - len(selected)))
    scores = {r.n_features: r.score for r in curve.collect()}
    assert sorted(scores) == [1, 2, 3, 4] and scores[2] > scores[1]


def test_many_k_at_once_equal_lloyd_alone(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    centres = {k: cluster.first_centres(x, k, k) for k in (1, 2, 4, 6)}
    got = cluster.lloyd_side_by_side(rows, centres, tol=1e-9)
    for k, c in centres.items():
        for _ in range(51):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            own, inertia = d.argmin(1), d.min(1).sum()
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        assert np.allclose(got[k][0], c) and abs(got[k][1] - inertia) < 1e-6
    df = spark.createDataFrame([(i, float(a), None if i == 7 else float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    curve = {r.k: r.inertia for r in cluster.kmeans_inertia_curve(df, "row_id", ["a", "b"]).collect()}
    keep = np.delete(x, 7, axis=0)
    assert sorted(curve) == list(range(1, 11)) and abs(curve[1] - ((keep - keep.mean(0)) ** 2).sum()) < 1e-6 and curve[4] < 0.1 * curve[1]


def test_every_pair_has_a_row_and_broken_links_show(spark):
    rng = random.Random(6)
    real = [(rng.gauss(0, 1),) for _ in range(800)]
    real = [(x, "hi" if x > 0 else "lo", rng.choice("ab")) for (x,) in real]
    mixed = [(x, s, t) for (x, _, t), (_, s, _) in zip(real, reversed(real))]
    schema = "n double, s string, t string"
    same, broken = ({(r.a, r.b): r.score for r in synth.pair_trend_score(spark.createDataFrame(real, schema), spark.createDataFrame(o, schema), ["n"], ["s", "t"]).collect()}
                    for o in (real, mixed))
    assert same.keys() == {("n", "s"), ("n", "t"), ("s", "t")} and all(abs(v - 1) < 1e-9 for v in same.values())
    assert broken["n", "s"] < 0.65 and broken["n", "t"] > 0.9


def test_units_do_not_matter_and_rounds_are_told(spark):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        a = rng.gauss(0, 1)
        rows.append((i, a, None if rng.random() < 0.3 else 2 * a + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    big = df.select("row_id", (F.col("a") * 1e6 + 1e9).alias("a"), (F.col("b") * 1e-6).alias("b"))
    for fit in (lowrank.em_fit, lowrank.softimpute_fit):
        one, report = fit(df, ["a", "b"])
        two, other = fit(big, ["a", "b"])
        x, y = ({r.row_id: r.b for r in t.collect()} for t in (one, two))
        assert max(abs(x[i] - y[i] * 1e6) for i in x) < 1e-3
        told, told2 = report.collect(), other.collect()
        assert len(told) == len(told2) and told[-1].converged and not any(r.converged for r in told[:-1])


def test_softimpute_writes_the_table_once_and_follows_the_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 1)) @ rng.normal(size=(1, 4)) * 3 + rng.normal(size=(200, 4)) + 10
    gone = rng.random(x.shape) < 0.2
    rows = [(i, *(None if g else float(v) for v, g in zip(r, m, strict=True))) for i, (r, m) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    written = []
    cut = lowrank.cut_lineage
    monkeypatch.setattr(lowrank, "cut_lineage", lambda t: written.append(1) or cut(t))
    out, report = lowrank.softimpute_fit(df, list("abcd"), tol=1e-6)
    got = np.array([r[1:] for r in sorted(out.collect())])
    assert len(written) == 1
    seen = np.where(gone, np.nan, x)
    mu, sd = np.nanmean(seen, axis=0), np.nanstd(seen, axis=0, ddof=1)
    z, lam, changes = np.where(gone, 0, (x - mu) / sd), None, []
    for _ in range(100):
        w, v = np.linalg.eigh(z.T @ z)
        sv = np.sqrt(w)
        lam = sv.max() / 50 if lam is None else lam
        new = np.where(gone, z @ (v @ np.diag(np.clip(sv - lam, 0, None) / sv) @ v.T), z)
        changes.append(np.abs(new - z).sum() / gone.sum())
        z = new
        if changes[-1] < 1e-6:
            break
    assert np.allclose([r.change for r in report.orderBy("round").collect()], changes, rtol=1e-6, atol=1e-12)
    assert np.allclose(got, z * sd + mu)
    monkeypatch.setattr(lowrank, "MAX_PATTERNS", 3)
    rows_way, report = lowrank.softimpute_fit(df, list("abcd"), max_rounds=3)
    assert np.allclose([r.change for r in report.orderBy("round").collect()], changes[:3])
    assert [r.row_id for r in rows_way.orderBy("row_id").collect()] == list(range(200))
