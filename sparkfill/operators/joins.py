"""Joins (C1-C3, C5, C7, C8, C11). Alignment is always by key (S1), never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import dense_codes
from sparkfill.session import broadcast_checked


def lookup_left_join(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left equi-join of a lookup table (C1); broadcast only after a size check."""
    return df.join(broadcast_checked(lookup), on, "left")


def align_columns(df: DataFrame, other: DataFrame, cols: Sequence[str], key: str = "row_id",
                  rename: dict | None = None) -> DataFrame:
    """Bring ``cols`` of a second extract onto ``df`` by key."""
    sel = [F.col(c).alias((rename or {}).get(c, c)) for c in cols]
    return df.join(other.select(key, *sel), key, "left")


def semi_join_truth(df: DataFrame, truth: DataFrame, key: str = "row_id", require_complete: bool = True) -> DataFrame:
    """Keep records that have a (complete) truth row."""
    t = truth.na.drop() if require_complete else truth
    return df.join(t.select(key), key, "left_semi")


def attach_cluster(df: DataFrame, clusters: DataFrame, key: str = "row_id", cluster_col: str = "cluster",
                   only: int | None = None) -> DataFrame:
    """Attach the cluster label by key, optionally keeping one cluster."""
    out = df.join(clusters.select(key, cluster_col), key, "left")
    return out.where(F.col(cluster_col) == only) if only is not None else out


def compare_counts(truth: DataFrame, imputed: DataFrame, value_col: str, fill_zero: bool = True) -> DataFrame:
    """(value, n_true, n_imputed): full outer join of two frequency tables."""
    t = truth.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count(F.lit(1)).alias("n_true"))
    i = imputed.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count(F.lit(1)).alias("n_imputed"))
    out = t.join(i, value_col, "full")
    return out.fillna(0, ["n_true", "n_imputed"]) if fill_zero else out


def write_back(df: DataFrame, fills: DataFrame, column: str, key: str = "row_id", value_col: str = "value") -> DataFrame:
    """Update ``column`` only where it is missing, from a (key, value) table (C11)."""
    f = fills.select(key, F.col(value_col).alias("__fill"))
    out = df.join(f, key, "left")
    t = dict(df.dtypes)[column]
    return out.withColumn(column, F.coalesce(F.col(column), F.col("__fill").cast(t))).drop("__fill")


def nearest_code_join(df: DataFrame, value_col: str, codes: DataFrame, code_col: str,
                      out: str = "code") -> DataFrame:
    """Snap a numeric value to the nearest known code; ties go to the lower code.

    Each code owns the half-open interval between the midpoints to its
    neighbours, so the answer is an interval (range) join. Intervals are cut
    into equal-width buckets and joined on the bucket number, then filtered:
    exact, no pairwise comparison, and the interval table has O(#codes) rows.
    Neighbours come from dense ranks (equi-joins on rank +- 1), not a global window.
    """
    ranked = dense_codes(codes.select(F.col(code_col).cast("double").alias("k")), [], "k", "r")
    prev = ranked.select((F.col("r") + 1).alias("r"), F.col("k").alias("kp"))
    nxt = ranked.select((F.col("r") - 1).alias("r"), F.col("k").alias("kn"))
    iv = ranked.join(prev, "r", "left").join(nxt, "r", "left")
    vals = df.where(F.col(value_col).isNotNull())
    st = vals.agg(F.min(value_col).alias("vmin"), F.max(value_col).alias("vmax")).first()
    ks = iv.agg(F.count(F.lit(1)).alias("nk"), F.min("k").alias("kmin"), F.max("k").alias("kmax")).first()
    if ks["nk"] == 0 or st["vmin"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    lo_all = min(float(st["vmin"]), float(ks["kmin"])) - 1.0
    hi_all = max(float(st["vmax"]), float(ks["kmax"])) + 1.0
    width = max((hi_all - lo_all) / (4.0 * ks["nk"]), 1e-9)
    iv = iv.select(
        "k",
        F.coalesce((F.col("kp") + F.col("k")) / 2, F.lit(lo_all)).alias("lo"),   # exclusive
        F.coalesce((F.col("k") + F.col("kn")) / 2, F.lit(hi_all)).alias("hi"))   # inclusive
    b_of = lambda c: F.floor((c - F.lit(lo_all)) / F.lit(width)).cast("bigint")
    iv = iv.withColumn("__b", F.explode(F.sequence(b_of(F.col("lo")), b_of(F.col("hi")))))
    v = df.withColumn("__b", b_of(F.col(value_col).cast("double")))
    j = v.join(broadcast_checked(iv), "__b", "left")
    x = F.col(value_col).cast("double")
    hit = (x > F.col("lo")) & (x <= F.col("hi"))
    j = j.where(hit | F.col("k").isNull() | F.col(value_col).isNull())
    # rows of a bucket that are not inside an interval were duplicated by the join: drop them
    # (exactly one interval holds each value)
    return j.drop("__b", "lo", "hi").withColumnRenamed("k", out)
