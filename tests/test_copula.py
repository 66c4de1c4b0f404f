"""The learned sampler against planted tables: hidden correlations, shapes, pairs, missing cells, odd tables."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfill.operators import copula, synth

SCHEMA = "row_id long, num double, whole int, grade int, colour string, hole double"
RHO = np.array([[1, 0.7, -0.5, 0.3, 0.4], [0.7, 1, -0.3, 0.2, 0.2], [-0.5, -0.3, 1, 0.4, -0.2], [0.3, 0.2, 0.4, 1, 0.1], [0.4, 0.2, -0.2, 0.1, 1]])


def planted(n=6000, seed=1):
    """num, whole, grade, colour and hole are cut from normals of correlation RHO; hole is null where num is large."""
    rng = np.random.default_rng(seed)
    z = rng.multivariate_normal(np.zeros(5), RHO, n)
    lost = 0.8 * z[:, 0] + 0.6 * rng.normal(size=n) > 0.5
    return [(i, math.exp(a), int(round(10 * b)), int(np.searchsorted([-1, 0, 1], c)), "abc"[int(np.searchsorted([-0.5, 0.8], d))], None if gone else float(e))
            for i, ((a, b, c, d, e), gone) in enumerate(zip(z.tolist(), lost.tolist(), strict=True))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(planted(), SCHEMA).cache()


@pytest.fixture(scope="module")
def model(table):
    return copula.fit(table, ["num", "whole", "hole"], ["grade", "colour"])


@pytest.mark.parametrize("rho", [-0.9, -0.3, 0.0, 0.5, 0.95])
def test_rectangles_of_the_bivariate_normal(rho):
    p = copula.rectangles(np.array([0.0]), np.array([0.0]), math.asin(rho))
    assert abs(p[0, 0] - (0.25 + math.asin(rho) / (2 * math.pi))) < 1e-7  # closed form of a quadrant
    x = np.random.default_rng(2).multivariate_normal([0, 0], [[1, rho], [rho, 1]], 400_000)
    a, b = np.array([-1.0, 0.4]), np.array([-0.2, 0.9, 1.5])
    seen = np.zeros((3, 4))
    np.add.at(seen, (np.searchsorted(a, x[:, 0]), np.searchsorted(b, x[:, 1])), 1 / len(x))
    p = copula.rectangles(a, b, math.asin(rho))
    assert np.abs(p - seen).max() < 4e-3 and abs(p.sum() - 1) < 1e-12


@pytest.mark.parametrize("rho", [-0.8, 0.0, 0.35, 0.9])
def test_polychoric_recovers_the_correlation_of_exact_tables(rho):
    table = 1e6 * copula.rectangles(np.array([-1.0, 0.3, 1.1]), np.array([-0.4, 0.6]), math.asin(rho))
    assert abs(copula.polychoric(table) - rho) < 1e-3
    assert abs(copula.polychoric(table[::-1]) + rho) < 1e-3  # levels turned round


def test_hidden_correlations_of_numbers_and_categories(model):
    at = {c: model.hidden.index(c) for c in model.hidden}
    cols = ["num", "whole", "grade", "colour"]
    got = model.correlation[np.ix_([at[c] for c in cols], [at[c] for c in cols])]
    assert np.abs(got - RHO[:4, :4]).max() < 0.06
    assert abs(model.correlation[at["hole missing"], at["num"]] - 0.8) < 0.06


def test_sample_has_the_shapes_pairs_and_missing_cells_of_the_table(spark, table, model):
    made = copula.sample(spark, model, 9000).cache()
    assert made.count() == 9000 and made.columns[0] == "row_id"
    assert {f.name: f.dataType for f in made.schema if f.name != "row_id"} == {f.name: f.dataType for f in table.schema if f.name != "row_id"}
    num, cat = ["num", "whole", "hole"], ["grade", "colour"]
    assert all(r.score > 0.95 for r in synth.column_shape_score(table, made, num, cat).collect())
    assert all(r.score > 0.9 for r in synth.pair_trend_score(table, made, num, cat).collect())
    for c in (F.col("num") > 2, F.col("num") < 0.5):  # missing where the table has it missing
        a, b = (d.where(c).agg(F.avg(F.col("hole").isNull().cast("double"))).first()[0] for d in (table, made))
        assert abs(a - b) < 0.05


def test_same_seed_same_rows_and_other_seed_other_rows(spark, model):
    a, b = (copula.sample(spark, model, 50).orderBy("row_id").collect() for _ in range(2))
    assert a == b == copula.sample(spark, model, 80).where("row_id < 50").orderBy("row_id").collect()
    assert a != copula.sample(spark, model, 50, seed="other").orderBy("row_id").collect()
    assert copula.sample(spark, model, 0).count() == 0


def test_odd_columns(spark):
    rows = [(None, 5, None, "x", float("nan")), (None, 5, None, None, 1.0), (None, 5, None, "x", 2.0), (None, 5, None, "it's", None)]
    df = spark.createDataFrame(rows, "none double, same int, no string, text string, nan double")
    made = copula.sample(spark, copula.fit(df, ["none", "same", "nan"], ["no", "text"]), 400).collect()
    assert all(r.none is None and r.no is None and r.same == 5 for r in made)
    assert {r.text for r in made} == {"x", "it's", None}
    assert {r.nan is None for r in made} == {True, False} and all(r.nan is None or 1 <= r.nan <= 2 for r in made)
    empty = copula.fit(df.limit(0), ["same"], ["text"])
    assert {(r.same, r.text) for r in copula.sample(spark, empty, 3).collect()} == {(None, None)}


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError, match="levels"):
        copula.fit(spark.range(500), [], ["id"])


def test_parameters_are_listed(spark, model):
    kinds = {r.kind: r.n for r in copula.parameters(spark, model).groupBy("kind").agg(F.count("a").alias("n")).collect()}
    assert kinds == {"missing_share": 5, "level_share": 7, "quantile": 15, "correlation": 15}
