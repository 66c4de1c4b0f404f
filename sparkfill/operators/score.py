"""Scoring fills against truth."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long_predictions(df: DataFrame, truth: str, strategies: Sequence[str]) -> DataFrame:
    return (df.select(F.col(truth).cast("double").alias("truth"),
                      *[F.col(s).cast("double").alias(s) for s in strategies])
              .unpivot(["truth"], list(strategies), "strategy", "pred"))


def score_mae(df: DataFrame, truth: str, strategies: Sequence[str], target: str) -> DataFrame:
    """(strategy, target, mae, n): mean |pred - truth| per strategy column, rows with both present."""
    lp = _long_predictions(df, truth, strategies).where(F.col("pred").isNotNull() & F.col("truth").isNotNull())
    return (lp.groupBy("strategy")
              .agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"),
                   F.count(F.lit(1)).alias("n"))
              .select("strategy", F.lit(target).alias("target"), "mae", "n"))


def confusion(df: DataFrame, truth: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., truth, pred, n) counts."""
    return (df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
              .groupBy(*group_cols, F.col(truth).cast("double").alias("t"), F.col(pred).cast("double").alias("p"))
              .agg(F.count(F.lit(1)).alias("n")))


def score_class(df: DataFrame, truth: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro F1 (beta 1, zero division 0) per group.

    Classes are the union of truth and prediction values; a class with no
    predicted (or no true) rows has precision (recall) 0."""
    g = list(group_cols)
    cm = confusion(df, truth, pred, g)
    # each confusion cell counts once for its true class and once for its predicted class:
    # one pass and one grouped aggregate give tp, npred and ntrue for every class
    cells = cm.select(*g, F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("ntrue"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("npred")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("ntrue"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("npred")))).alias("c"))
    per = cells.groupBy(*g, F.col("c.cls").alias("cls")).agg(
        F.sum("c.tp").alias("tp"), F.sum("c.npred").alias("npred"), F.sum("c.ntrue").alias("ntrue"))
    per = per.withColumn("prec", F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)) \
             .withColumn("rec", F.when(F.col("ntrue") > 0, F.col("tp") / F.col("ntrue")).otherwise(0.0)) \
             .withColumn("f1", F.when(F.col("prec") + F.col("rec") > 0,
                                      2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec")))
                         .otherwise(0.0))
    return per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("ntrue")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("ntrue").alias("n"))


def wilson_interval(df: DataFrame, match_col: str, z: float = 1.959963984540054,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Agreement rate with a Wilson score interval."""
    n = F.count(F.col(match_col))
    p = F.avg(F.col(match_col).cast("double"))
    agg = df.groupBy(*group_cols).agg(p.alias("rate"), n.alias("n"))
    z2 = z * z
    centre = (F.col("rate") + z2 / (2 * F.col("n"))) / (1 + z2 / F.col("n"))
    half = (z / (1 + z2 / F.col("n"))) * F.sqrt(
        F.col("rate") * (1 - F.col("rate")) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))
    return agg.select(*group_cols, "rate", "n", (centre - half).alias("low"), (centre + half).alias("high"))


def pick_best(scores: DataFrame, model_col: str, score_col: str, lower_is_better: bool,
              index_col: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean score per model over test sets, then the best model per group.

    Ties go to the lowest ``index_col`` (default: the model name)."""
    idx = index_col or model_col
    g = list(group_cols)
    keys = g + [model_col] + ([idx] if idx != model_col else [])
    avg = scores.groupBy(*keys).agg(F.avg(score_col).alias("mean_score"))
    key = F.struct((F.col("mean_score") if lower_is_better else -F.col("mean_score")).alias("s"), F.col(idx).alias("i"))
    return avg.groupBy(*g).agg(F.min_by(model_col, key).alias("best_model"),
                               F.min_by("mean_score", key).alias("best_score"))


def cross_score(models_preds: DataFrame, truth: str, pred: str, continuous: bool,
                model_col: str = "model", sim_col: str = "sim") -> DataFrame:
    """Every model on every simulated test set (C10): one grouped score per (model, sim)."""
    if continuous:
        return (models_preds.groupBy(model_col, sim_col)
                .agg(F.avg(F.abs(F.col(pred) - F.col(truth))).alias("score")))
    return (models_preds.groupBy(model_col, sim_col)
            .agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("score")))


def z_for(confidence: float) -> float:
    """Two-sided normal quantile, for the Wilson interval (pure math)."""
    # inverse error function by Newton on erf
    p = (1 + confidence) / 2
    x = 0.0
    for _ in range(100):
        err = 0.5 * (1 + math.erf(x / math.sqrt(2))) - p
        x -= err / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    return x

