"""Shapley values against the enumeration of all sets of features."""
import itertools
import math
import random

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressor
from sparkfill.operators import attribution
from sparkfill.operators.cluster import assemble


def expected(node, row, known):
    if "leaf" in node:
        return node["value"]
    if node["feature"] in known:
        return expected(node["left"] if row[node["feature"]] <= node["at"] else node["right"], row, known)
    n = node["left"]["n"] + node["right"]["n"]
    return sum(node[s]["n"] / n * expected(node[s], row, known) for s in ("left", "right"))


def brute(tree, row, n):
    out = []
    for i in range(n):
        total = 0.0
        for k in range(n):
            for known in itertools.combinations([j for j in range(n) if j != i], k):
                w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                total += w * (expected(tree, row, {*known, i}) - expected(tree, row, set(known)))
        out.append(total)
    return out


def test_equal_to_all_sets_of_features(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a, b, c, d = (rng.uniform(0, 1) for _ in range(4))
        rows.append((i, a, b, c, d, 3 * a + (5 if b > 0.5 and c > 0.3 else 0) - 2 * a * c + rng.gauss(0, 0.05)))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double")
    model = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=5, seed=1).fit(assemble(df, names))
    got = {r.row_id: r for r in attribution.tree_attribution(model, df, df, names, "y", "row_id").collect()}
    model.setLeafCol("__leaf")
    counts = {int(r["__leaf"]): r["count"] for r in model.transform(assemble(df, names)).groupBy("__leaf").count().collect()}
    tree = attribution.parse_tree(model.toDebugString)
    attribution.leaf_paths(tree, counts)  # counts the rows of every node
    mean = np.mean([r[5] for r in rows])
    for i in range(0, 400, 13):
        credits = [got[i][f"attr_{f}"] for f in names]
        assert np.allclose(credits, brute(tree, rows[i][1:5], 4), atol=1e-9)
        assert abs(got[i].base + sum(credits) - got[i].pred) < 1e-9 and abs(got[i].base - mean) < 1e-9


def test_a_leaf_alone_and_a_repeated_feature():
    assert attribution.shapley([(2.5, [])], np.zeros((3, 2)))[0] == 2.5
    tree = {"feature": 0, "at": 1.0, "left": {"leaf": 0, "value": 0.0}, "right": {"feature": 0, "at": 2.0, "left": {"leaf": 1, "value": 4.0}, "right": {"leaf": 2, "value": 8.0}}}
    base, credits = attribution.shapley(attribution.leaf_paths(tree, {0: 2, 1: 1, 2: 1}), np.array([[0.5], [1.5], [2.5], [np.nan]]))
    assert base == 3.0 and credits[:, 0].tolist() == [-3.0, 1.0, 5.0, 5.0]
