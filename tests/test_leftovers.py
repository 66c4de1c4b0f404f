"""What the operators leave on disk, and how many fits run at once."""
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from sparkfill import session
from sparkfill.operators import select, stack


def test_a_simulation_leaves_only_its_labels(spark, monkeypatch):
    """The masked table, the clusters and their fills of every simulation stayed on disk."""
    left, write = [], session.shared_path
    monkeypatch.setattr(session, "shared_path", lambda *a: left.append(write(*a)) or left[-1])
    rng = random.Random(7)
    rows = [(i, i % 2, rng.uniform(0, 9), None if i % 6 == 0 else float(i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, g int, x double, y double")
    truth = spark.createDataFrame([(r[0], float(r[0] % 40)) for r in rows], "row_id long, y double")
    lab = stack._labelled(df, truth, "row_id", "y", ["x"], df.select("row_id", F.col("g").alias("cluster")), False, "ice", 0, None)
    n = lab.count()
    assert n > 0 and lab.where("y_imputed_cluster is null").count() == 0
    assert len(left) >= 3 and not any(os.path.exists(p.removeprefix("file:")) for p in left)


@pytest.mark.parametrize("most", [1, 10_000])
def test_folds_of_many_rows_are_fitted_one_after_the_other(spark, monkeypatch, most):
    """All folds were fitted at once, whatever their size, and each fit keeps its rows in memory."""
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)]
    df = spark.createDataFrame([(i, x, z, 3 * x) for i, x, z in rows], "row_id long, x double, z double, y double")
    now, seen, lock, whole = [0], [0], threading.Lock(), select._eliminated

    def counted(*a):
        with lock:
            now[0] += 1
            seen[0] = max(seen[0], now[0])
        out = whole(*a)
        with lock:
            now[0] -= 1
        return out

    monkeypatch.setattr(select, "_eliminated", counted)
    monkeypatch.setattr(select, "SIDE_BY_SIDE", most)
    selected, ranks, curve = select.rfe_cv(df, "row_id", "y", ["x", "z"], folds=3)
    assert "x" in selected and ranks.count() == curve.count() == 2
    assert (seen[0] == 1) == (most == 1)
