"""Window, ordering and top-k operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_bottom_k(df: DataFrame, group_cols: Sequence[str], order_col: str, k: int, key: str,
                 sum_col: str) -> DataFrame:
    """Per group: sum of ``sum_col`` over the k smallest and the k largest rows by ``order_col``
    (ties by key) (E1). ``row_number() <= k`` lets Spark insert a WindowGroupLimit, which
    keeps only k rows per group in each map task before the shuffle."""
    g = list(group_cols)
    w_lo = Window.partitionBy(*g).orderBy(F.col(order_col).asc(), F.col(key).asc())
    w_hi = Window.partitionBy(*g).orderBy(F.col(order_col).desc(), F.col(key).asc())
    d = df.where(F.col(order_col).isNotNull())
    near = d.withColumn("__rn", F.row_number().over(w_lo)).where(F.col("__rn") <= k) \
        .groupBy(*g).agg(F.sum(sum_col).alias("sum_near"), F.count(F.lit(1)).alias("n_near"))
    far = d.withColumn("__rn", F.row_number().over(w_hi)).where(F.col("__rn") <= k) \
        .groupBy(*g).agg(F.sum(sum_col).alias("sum_far"), F.count(F.lit(1)).alias("n_far"))
    return near.join(far, g, "full") if g else near.crossJoin(far)


def rank_features(weights: DataFrame, name_col: str = "column", weight_col: str = "weight") -> DataFrame:
    """Columns sorted by weight descending with their rank (E2). ``weights`` has one row per column."""
    w = Window.orderBy(F.desc(weight_col), F.asc(name_col))
    return weights.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def elbow_k(curve: DataFrame, k_col: str = "k", y_col: str = "inertia", offset: int = 1) -> DataFrame:
    """Elbow of an inertia curve by largest distance to the first-last chord.

    y is min-max normalised, x is the position 0..m-1 (not normalised). Returns one
    row: ``elbow_index`` and ``k`` = k at that index + offset (1 for a flat curve)."""
    c = curve.select(F.col(k_col).alias("k"), F.col(y_col).cast("double").alias("y"))
    w = Window.orderBy("k")  # the curve has a handful of rows (k = 1..10)
    c = c.withColumn("i", F.row_number().over(w) - 1)
    st = c.agg(F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.max("i").alias("m"),
               F.min_by("y", "i").alias("y0"), F.max_by("y", "i").alias("ylast"))
    c = c.crossJoin(F.broadcast(st))
    rng = F.col("ymax") - F.col("ymin")
    safe = F.when(rng > 0, rng)            # flat curve: null instead of a division by zero
    ny = (F.col("y") - F.col("ymin")) / safe
    n0 = (F.col("y0") - F.col("ymin")) / safe
    nl = (F.col("ylast") - F.col("ymin")) / safe
    dx, dy = F.col("m").cast("double"), nl - n0
    dist = F.abs(F.col("i") * dy - (ny - n0) * dx) / F.when(dx * dx + dy * dy > 0, F.sqrt(dx * dx + dy * dy))
    c = c.withColumn("ny", ny).withColumn("dist", dist)
    best = c.agg(F.min_by(F.struct("i", "k"), F.struct((-F.col("dist")).alias("d"), F.col("i"))).alias("b"),
                 F.first(rng).alias("rng"))
    return best.select(
        F.when(F.col("rng") > 0, F.col("b.i")).alias("elbow_index"),
        F.when(F.col("rng") > 0, F.col("b.k") + offset).otherwise(F.lit(1)).cast("int").alias("k"))


def argmin_group(df: DataFrame, group_col: str, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """The group with least value (ties: least group), per ``by`` (E5)."""
    return df.groupBy(*by).agg(
        F.min_by(group_col, F.struct(F.col(value_col).alias("v"), F.col(group_col).alias("g"))).alias(f"best_{group_col}"),
        F.min(value_col).alias("best_value"))


def cumulative_variance(ratios: DataFrame, idx_col: str = "i", ratio_col: str = "ratio",
                        threshold: float = 0.95) -> DataFrame:
    """Running sum of explained ratios and the first n reaching the threshold, 0 if never.

    ``ratios`` holds one row per component (a handful of rows)."""
    w = Window.orderBy(idx_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = ratios.withColumn("cum", F.sum(ratio_col).over(w)) \
        .withColumn("n", F.row_number().over(Window.orderBy(idx_col)))
    n95 = c.agg(F.coalesce(F.min(F.when(F.col("cum") >= threshold, F.col("n"))), F.lit(0)).alias("n_components"))
    return c.crossJoin(F.broadcast(n95))


def closest_strategy(cols: Sequence[str], truth: str) -> Column:
    """struct(idx, value) of the strategy column nearest to truth; first on ties."""
    arr = F.array(*[F.struct(F.abs(F.col(c) - F.col(truth)).alias("d"), F.lit(i).alias("idx"),
                             F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    return F.array_min(F.filter(arr, lambda e: e["d"].isNotNull()))
