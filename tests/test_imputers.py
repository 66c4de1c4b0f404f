"""Chained imputers, grouped chains and the benchmark's settings on planted tables."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfill.operators.impute import chained, equations, grouped, registry, strategies


def planted(spark, n=600, seed=0, relabel=None):
    """``y = 3x + shift of the colour + noise``; the colour follows ``z``; some cells hidden. ``relabel`` renames the colours."""
    rng = random.Random(seed)
    shift = {"red": 0.0, "green": 40.0, "blue": -30.0}
    rows, truth = [], {}
    for i in range(n):
        colour = rng.choice(sorted(shift))
        x, z = rng.uniform(0, 10), {"red": 0, "green": 5, "blue": 10}[colour] + rng.uniform(-1.5, 1.5)
        y = 3 * x + shift[colour] + rng.gauss(0, 1)
        truth[i] = (y, colour)
        hide_y, hide_c = rng.random() < 0.25, rng.random() < 0.15
        name = relabel[colour] if relabel else colour
        rows.append((i, x, z, None if hide_c else name, None if hide_y else y))
    kind = "string" if not relabel or isinstance(next(iter(relabel.values())), str) else "int"
    return spark.createDataFrame(rows, f"row_id long, x double, z double, colour {kind}, y double"), truth, rows


COLS = ["x", "z", "colour", "y"]


def test_ice_finds_the_plant_and_says_how_it_went(spark):
    df, truth, rows = planted(spark)
    out, report = equations.chained_equations(df, COLS, "row_id", ["colour"])
    got = {r.row_id: r for r in out.collect()}
    assert out.columns == df.columns and len(got) == len(rows)
    for i, x, z, colour, y in rows:
        r = got[i]
        assert (colour is None or r.colour == colour) and (y is None or r.y == y) and r.x == x
        assert r.colour == truth[i][1]
    gone = [i for i, *_, y in rows if y is None]
    assert np.mean([abs(got[i].y - truth[i][0]) for i in gone]) < 1.2  # the noise alone is 0.8
    rounds = report.collect()
    assert {r.column for r in rounds} == {"colour", "y"} and rounds[-1].converged and max(r.round for r in rounds) < 10


def test_names_of_codes_do_not_matter(spark):
    plain, _, rows = planted(spark)
    a = {r.row_id: r.y for r in equations.chained_equations(plain, COLS, "row_id", ["colour"])[0].collect()}
    mixed, _, _ = planted(spark, relabel={"red": 907, "green": 3, "blue": 44})
    out = equations.chained_equations(mixed, COLS, "row_id", ["colour"])[0].collect()
    assert max(abs(a[r.row_id] - r.y) for r in out) < 1e-6 and {r.colour for r in out} == {907, 3, 44}


def test_a_number_is_least_squares(spark):
    df, _, rows = planted(spark)
    got = {r.row_id: r.y for r in registry.impute_table(df.select("row_id", "x", "z", "y"), ["x", "z", "y"], "ice").collect()}
    known = np.array([(1, x, z, y) for _, x, z, _, y in rows if y is not None])
    w = np.linalg.lstsq(known[:, :3], known[:, 3], rcond=None)[0]
    low, high = known[:, 3].min(), known[:, 3].max()
    for i, x, z, _, y in rows:
        if y is None:
            assert abs(got[i] - min(max(np.array([1, x, z]) @ w, low), high)) < 1e-8


def test_steps_raise_the_likelihood(spark):
    df, _, _ = planted(spark, 300)
    full = df.na.drop().withColumn("z", F.col("z") + 8 * F.sin(F.col("row_id"))).withColumn("y", F.col("x") * F.col("x"))
    columns, _ = equations.describe(full, COLS, ["colour"])
    design = equations.Design(columns)
    state = equations._start(full, "row_id", design)
    values = np.array([r.cur for r in state.collect()])
    x, y = design.matrix(values, 2), values[:, 2].astype(int)
    seen = []
    for steps in (0, 1, 3, 8):
        w = equations.fit_column(state, design, [], 2, steps, None).weights[0]
        seen.append(np.log(np.maximum(equations.probabilities(x, w)[np.arange(len(y)), y], 1e-300)).sum())
    assert seen == sorted(seen) and seen[-1] > seen[0]


def test_mice_votes_match_donors_and_cover(spark):
    df, truth, rows = planted(spark)
    five, _ = equations.chained_equations(df, COLS, "row_id", ["colour"], max_rounds=3, imputations=5, draw=True)
    got = {r.row_id: r for r in five.collect()}
    assert {r.colour for r in got.values()} == {"red", "green", "blue"}
    gone = [i for i, *_, y in rows if y is None]
    assert np.mean([abs(got[i].y - truth[i][0]) for i in gone]) < 1.5
    one, _ = equations.chained_equations(df, COLS, "row_id", ["colour"], max_rounds=2, imputations=1, draw=True)
    seen = {y for *_, y in rows if y is not None}
    assert all(min(abs(r.y - s) for s in seen) < 1e-9 for r in one.collect())  # values of donors
    runs = [{r.row_id: r.y for r in equations.chained_equations(df, COLS, "row_id", ["colour"], max_rounds=2, draw=True, match=False, seed=s)[0].collect()} for s in range(12)]
    inside = np.mean([min(r[i] for r in runs) <= truth[i][0] <= max(r[i] for r in runs) for i in gone])
    assert inside > 0.7  # 12 draws should hold the truth in 11 of 13 cases


def test_votes_are_codes_somebody_drew(spark):
    design = equations.Design([equations.Variable("c", [3, 5, 9])], 5)
    state = spark.createDataFrame([(1, 1, [None], [0.0, 0.0, 0.0, 2.0, 2.0]), (2, 2, [None], [2.0, 1.0, 1.0, 2.0, 0.0])], "key long, kh long, obs array<double>, cur array<double>")
    df = spark.createDataFrame([(1, None), (2, None)], "row_id long, c int")
    out = equations._finished(df, "row_id", state, design, [0]).orderBy("row_id").collect()
    assert [r.c for r in out] == [3, 5]  # 3, 3, 3, 9, 9 gives 3; of equal votes the lower code


def test_nearest_donors_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0.5, 0.25, rng.uniform(-3, 3)]), None if rng.random() < 0.4 else float(k)) for k in range(400) for i in range(2)]
    df = spark.createDataFrame(rows, "key long, imp int, pred double, value double")
    monkeypatch.setattr(equations, "PART_ROWS", 60)
    got = {(r.key, r.imp): r.donor for r in equations.nearest_donors(df).collect()}
    pred = {(k, i): p for k, i, p, _ in rows}
    assert got.keys() == {(k, i) for k, i, _, v in rows if v is None}
    for (k, i), donor in got.items():
        best = min(abs(p - pred[k, i]) for _, j, p, v in rows if j == i and v is not None)
        assert abs(abs(pred[int(donor), i] - pred[k, i]) - best) < 1e-12


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, None, 1.0, None), (3, None, None, "a")], "row_id long, n double, c double, s string")
    out, _ = equations.chained_equations(df, ["n", "c", "s"], "row_id", ["s"])
    assert [tuple(r) for r in out.orderBy("row_id").collect()] == [(1, None, 1.0, "a"), (2, None, 1.0, "a"), (3, None, 1.0, "a")]
    none, report = equations.chained_equations(df.limit(0), ["n", "c", "s"], "row_id", ["s"])
    assert none.collect() == [] and report.collect() == []
    with pytest.raises(ValueError):
        equations.describe(spark.range(2000).withColumn("c", F.col("id")), ["c"], ["c"])


def test_race_and_choice(spark):
    df, truth, rows = planted(spark, 400)
    filled, report, races = chained.hyperimpute(df, COLS, "row_id", ["colour"], max_rounds=2, first=150,
                                                candidates={"linear": ("linear", {}), "flat": ("linear", {"regParam": 1e6})})
    got = {r.row_id: r for r in filled.collect()}
    table = races.collect()
    assert {(r.column, r.round) for r in table} == {(c, k) for c in ("colour", "y") for k in (1, 2)}
    assert {r.candidate for r in table if r.chosen} == {"linear"} and sum(r.chosen for r in table) == 4
    assert np.mean([abs(got[i].y - truth[i][0]) for i, *_, y in rows if y is None]) < 2.5
    assert {r.column for r in report.collect()} == {"colour", "y"}
    chooser = chained.Chooser({"a": ("linear", {})}, 0, settled=2)
    chooser.wins[3], chooser.scores[3] = ["a", "a"], [0.5, 0.5]
    assert chooser(None, [equations.Variable("p")] * 4, 3, 7) == ("linear", {}) and chooser.table == [("p", 7, "a", 0, 0, None, True)]


def test_missforest_stops_by_itself(spark):
    df, truth, rows = planted(spark, 300)
    out, report = chained.missforest(df, COLS, "row_id", ["colour"], trees=5, depth=5, max_rounds=6)
    got = {r.row_id: r for r in out.collect()}
    assert np.mean([got[i].colour == truth[i][1] for i, *_, c, _ in rows if c is None]) > 0.95
    assert max(r.round for r in report.collect()) <= 6


def test_grouped_chain_equals_the_loop(spark):
    rng = random.Random(7)
    slopes = {0: 2.0, 1: -1.0, 2: 0.5, None: 4.0}
    rows = []
    for i in range(900):
        c = rng.choice(list(slopes))
        x, w = rng.uniform(0, 10), rng.uniform(-5, 5)
        y = slopes[c] * x + w + rng.gauss(0, 0.1)
        rows.append((i, c, None if rng.random() < 0.1 else x, w, None if rng.random() < 0.3 else y, None if c == 2 else 1.0))
    df = spark.createDataFrame(rows, "row_id long, c int, x double, w double, y double, one double")
    got = {r.row_id: r for r in grouped.chained_by_cluster(df, "row_id", "c", ["y", "x", "w", "one"], tol=0.0, max_rounds=3).collect()}
    assert len(got) == 900
    for c in slopes:
        sub = df.where(F.col("c").eqNullSafe(F.lit(c)))
        cols = ["y", "x", "w"]
        want = {r.row_id: r for r in equations.chained_equations(sub.select("row_id", *cols), cols, "row_id", tol=0.0, max_rounds=3)[0].collect()}
        for i, r in want.items():
            assert abs(got[i].y - r.y) < 1e-6 and abs(got[i].x - r.x) < 1e-6
            assert got[i].one == (None if c == 2 else 1.0)
    out = strategies.impute_by_cluster(df, "row_id", "c", "y", ["x", "w"], "ice", min_size=50)
    assert out.where("y is null").count() == 0 and out.count() == 900


def test_each_setting_of_the_benchmark_matters(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        g, a, b, noise = rng.randrange(3), rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 1)
        # b is missing where y is high, so that an indicator of it tells something
        y = 5 * a + 30 * g + (20 if noise < 0.3 else 0) + rng.gauss(0, 1)
        rows.append((i, g, a, None if noise < 0.3 else b, y if rng.random() < 0.8 else None))
    df = spark.createDataFrame(rows, "row_id long, g int, a double, b double, y double")
    out = strategies.benchmark_imputers(df, "row_id", "y", ["ice"], [
        (("b",), None, False), (("a",), None, False), (("a",), "g", False), (("a", "b"), "g", True), ("LASSO", "reduced", False)], [0], ["a", "b"])
    maes = {(r.selection, r.clustering, r.mnar): r.mae for r in out.collect()}
    assert maes["b", "none", False] > maes["a", "none", False] + 1  # the right feature
    assert maes["a", "none", False] > maes["a", "g", False] + 5  # the right clusters
    assert maes["a", "g", False] > maes["a+b", "g", True] + 3  # the indicator
    assert ("LASSO", "reduced", False) in maes
