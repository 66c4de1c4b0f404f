"""Stacked ensemble over the three strategies (H15, H16, C10, I14; S20).

Three seeded maskings of the known target give three labelled sets (hidden rows,
their three strategy values, the truth). Each set trains one stacker; every
stacker is scored on every held-out part; the best mean score fills the cells that
are really missing. All sets are stacked with a ``sim`` column and scored in one
grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.operators import sampling, score
from sparkfill.operators.cluster import assemble
from sparkfill.operators.impute import strategies
from sparkfill.session import cut_lineage, passing, written

STRATEGY_SUFFIXES = ("_imputed_full", "_imputed_full_selected", "_imputed_cluster")


def fit_stacker(train: DataFrame, features: Sequence[str], label: str, categorical: bool, kind: str = "tree",
                seed: int = 42):
    """Decision tree (depth 15, at least 5 rows per node) or linear / logistic model."""
    d = assemble(train.withColumn("__y", F.col(label).cast("double")), features)
    if kind == "tree":
        est = (DecisionTreeClassifier if categorical else DecisionTreeRegressor)(
            featuresCol="features", labelCol="__y", maxDepth=15, minInstancesPerNode=5, seed=seed)
    elif categorical:
        est = LogisticRegression(featuresCol="features", labelCol="__y", maxIter=3000)
    else:
        est = LinearRegression(featuresCol="features", labelCol="__y")
    return est.fit(d)


def model_importances(model, features: Sequence[str], spark) -> DataFrame:
    """(column, importance) of a tree model, or |coefficient| of a linear one."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        coef = model.coefficients if hasattr(model, "coefficients") else model.coefficientMatrix.toArray()[0]
        vals = [abs(float(x)) for x in coef]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(features, vals)], "column string, importance double")


def predict(model, df: DataFrame, features: Sequence[str], out: str = "pred") -> DataFrame:
    p = model.transform(assemble(df, features))
    return p.withColumnRenamed("prediction", out).drop("features", "rawPrediction", "probability")


def model_by_testset(models: dict, tests: dict, features: Sequence[str], truth: str, continuous: bool) -> DataFrame:
    """Every model on every test set (C10): (model, sim, score)."""
    stacked = None
    for sim, t in tests.items():
        s = t.withColumn("sim", F.lit(sim))
        stacked = s if stacked is None else stacked.unionByName(s)
    scored = None
    for name, m in models.items():
        p = predict(m, stacked, features).withColumn("model", F.lit(name))
        scored = p if scored is None else scored.unionByName(p)
    return score.cross_score(scored, truth, "pred", continuous, "model", "sim")


def _labelled(df, truth, key, target, features, cluster_labels, categorical, method, sim, selected) -> DataFrame:
    """The fills of a simulation's hidden cells beside the truth. It is read by the fit and by every model's score; nothing else
    of the simulation is kept."""
    with passing(df.sparkSession):
        masked, hidden = sampling.mask_random(df, target, f"sim{sim}", key)
        masked = written(masked, "masked")  # the three strategies read it several times each
        strat = strategies.impute_three_ways(masked, key, target, features, cluster_labels, selected, method,
                                             round_codes=categorical)
        lab = strat.join(hidden, key).join(truth.select(key, F.col(target).cast("double").alias("__truth")), key)
        lab = cut_lineage(sampling.train_test_split(lab, 0.2, f"stack{sim}", key))
        del masked, hidden, strat  # so that their shuffles and checkpoints can go
    return lab


def impute_ensemble(df: DataFrame, truth: DataFrame, key: str, target: str, features: Sequence[str],
                    cluster_labels: DataFrame, categorical: bool = False, method: str = "mean", sims: int = 3,
                    kind: str = "tree", selected: Sequence[str] | None = None) -> dict:
    """Returns {'filled': df with target filled, 'scores': (model, sim, score), 'best': name}."""
    feats = [f"{target}{s}" for s in STRATEGY_SUFFIXES]
    models, tests = {}, {}
    for sim in range(sims):
        lab = _labelled(df, truth, key, target, features, cluster_labels, categorical, method, sim, selected)
        tr = lab.where(F.col("is_test") == 0)
        if categorical:
            tr = sampling.undersample(tr, "__truth", f"under{sim}", key)
        models[f"model_{sim}"] = fit_stacker(tr, feats, "__truth", categorical, kind)
        tests[sim] = lab.where(F.col("is_test") == 1)
    scores = model_by_testset(models, tests, feats, "__truth", not categorical)
    best = score.pick_best(scores.withColumn("idx", F.regexp_extract("model", r"(\d+)$", 1).cast("int")),
                           "model", "score", lower_is_better=not categorical, index_col="idx").first()["best_model"]
    real = strategies.impute_three_ways(df, key, target, features, cluster_labels, selected, method,
                                        round_codes=categorical)
    miss = df.where(F.col(target).isNull()).select(key)
    pred = predict(models[best], real.join(miss, key), feats, "__fill").select(key, "__fill")
    t = "double"
    filled = df.join(pred, key, "left").withColumn(
        target, F.coalesce(F.col(target).cast(t), F.rint("__fill") if categorical else F.col("__fill"))).drop("__fill")
    return {"filled": filled, "scores": scores, "best": best, "models": models}
