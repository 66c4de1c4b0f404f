"""Fitted models against closed forms and plain loops: PCA, stackers, the elastic net with cross-validation."""
import numpy as np
import pytest
from sparkfill.operators import cluster, select, stack


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2)) @ np.array([[3.0, 1.0, 0.5], [0.2, 1.5, -1.0]]) + rng.normal(scale=0.1, size=(300, 3)) + [5, -2, 1]
    return x, 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 2] + 3


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y = numbers
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))],
                                 "row_id long, a double, b double, c double, y double").cache()


def test_pca_equals_the_eigen_solve(table, numbers):
    x = numbers[0] - numbers[0].mean(0)
    w, v = np.linalg.eigh(np.cov(x.T))
    w, v = w[::-1], v[:, ::-1]
    scores, ratios, loadings = cluster.pca_reduce(table, "row_id", ["a", "b", "c"], variance=0.95)
    got = {r.i: r.ratio for r in ratios.collect()}
    assert np.allclose([got[i] for i in sorted(got)], (w / w.sum())[: len(got)])
    kept = int(np.searchsorted(np.cumsum(w / w.sum()), 0.95)) + 1
    assert scores.columns == ["row_id", *(f"pc_{i}" for i in range(kept))]
    z = np.array([list(r)[1:] for r in scores.orderBy("row_id").collect()])
    assert np.allclose(np.abs(z), np.abs(x @ v[:, :kept]))  # the sign of a component is free


def test_linear_stacker_equals_least_squares(table, numbers):
    model = stack.fit_stacker(table, ["a", "b", "c"], "y", categorical=False, kind="linear")
    assert np.allclose(model.coefficients.toArray(), [2, -1, 0.5], atol=1e-6) and abs(model.intercept - 3) < 1e-5


def test_tree_stacker_answers_the_means_of_its_leaves(table, numbers):
    model = stack.fit_stacker(table, ["a", "b", "c"], "y", categorical=False)
    leaves: dict[float, list[float]] = {}
    out = stack.predict(model, table, ["a", "b", "c"])
    vectors = cluster.assemble(table, ["a", "b", "c"]).select("row_id", "features").collect()
    leaf = {r.row_id: model.predictLeaf(r.features) for r in vectors}
    pred = {}
    for r in out.collect():
        leaves.setdefault(leaf[r.row_id], []).append(r.y)
        pred[leaf[r.row_id]] = r.pred
    assert len(leaves) > 5 and min(map(len, leaves.values())) >= 5
    assert all(abs(np.mean(v) - pred[k]) < 1e-9 for k, v in leaves.items())
    shares = {r.column: r.importance for r in stack.model_importances(model, ["a", "b", "c"], table.sparkSession).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == "a"


def _plain_elastic_net(x, y, alpha, l1, w):
    """Coordinate descent on the rows themselves, from ``w``."""
    x, y = x - x.mean(0), y - y.mean()
    w, n = w.copy(), len(y)
    for _ in range(1000):
        before = w.copy()
        for j in range(x.shape[1]):
            part = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / n
            w[j] = np.sign(part) * max(abs(part) - alpha * l1, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - l1))
        if np.abs(w - before).max() <= 1e-4 * np.abs(w).max():
            break
    return w


def test_elastic_net_from_sums_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(scale=0.5, size=120)
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))],
                                 "row_id long, a double, b double, c double, d double, y double")
    folded = select.contiguous_folds(rows, "row_id", 5)
    fold = np.arange(120) // 24
    assert [r.fold for r in folded.orderBy("row_id").collect()] == fold.tolist()
    got = select.elastic_net_path(select.gram_sums(folded, "fold", ["a", "b", "c", "d", "y"]), n_alphas=30)
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (120 * 0.5)
    alphas, mse = top * np.logspace(0, -3, 30), np.zeros(30)
    for f in range(5):
        w, train = np.zeros(4), fold != f
        for i, a in enumerate(alphas):
            w = _plain_elastic_net(x[train], y[train], a, 0.5, w)
            guess = y[train].mean() + (x[~train] - x[train].mean(0)) @ w
            mse[i] += ((y[~train] - guess) ** 2).mean() / 5
    assert np.allclose(got["mse"], mse, atol=1e-6) and np.isclose(got["alpha"], alphas[mse.argmin()])
    w = np.zeros(4)
    for a in alphas[: mse.argmin() + 1]:
        w = _plain_elastic_net(x, y, a, 0.5, w)
    assert np.allclose(got["coef"], w, atol=1e-6)


def test_sql_of_the_selection_follows_the_elastic_net(spark):
    import duckdb
    from sparkfill.operators import select
    from sparkfill.plans.q_models import elastic_net_ctes
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = 3 * x[:, 1] - x[:, 0] + rng.normal(0, 0.5, 300)
    rows = [(i, *map(float, r), None if i % 7 == 0 else float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")
    con = duckdb.connect()
    con.execute("CREATE TABLE rec (row_id BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO rec VALUES (?, ?, ?, ?, ?)", rows)
    weights = con.execute("WITH " + ",\n".join(elastic_net_ctes(["a", "b", "c"], "y")) + " SELECT * FROM en_sel").fetchone()
    selected, rank = select.select_elasticnet(df, "row_id", "y", ["a", "b", "c"])
    assert {"a", "b"} <= set(selected) == {c for c, w in zip("abc", weights, strict=True) if w != 0}
    assert np.allclose([r.weight for r in rank.orderBy("column").collect()], np.abs(weights), atol=1e-9)
