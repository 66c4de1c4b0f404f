"""Encoding and scaling.

Fitted state is a dimension DataFrame (column, value, code) or a one-row table
of statistics; applying it is a (checked) broadcast join or a literal expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import dense_codes, exact_quantiles
from sparkfill.functions.scalars import long_values
from sparkfill.session import broadcast_checked

INFREQUENT = "__infrequent__"


def fit_ordinal(df: DataFrame, column: str, min_frequency: int = 80) -> DataFrame:
    """Dimension (value, code, label) for one column.

    Categories with at least ``min_frequency`` rows get 0..m-1 in sorted order;
    all rarer ones share code m and decode to ``'__infrequent__'``."""
    cnt = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    freq = cnt.where(F.col("n") >= min_frequency)
    codes = dense_codes(freq, [], "value", "code")
    m = freq.agg(F.count(F.lit(1)).cast("int").alias("m"))
    rare = cnt.where(F.col("n") < min_frequency).crossJoin(F.broadcast(m)).select("value", F.col("m").alias("code"))
    return (codes.select("value", "code", F.col("value").cast("string").alias("label"))
            .unionByName(rare.select("value", "code", F.lit(INFREQUENT).alias("label"))))


def apply_ordinal(df: DataFrame, column: str, dim: DataFrame, out: str | None = None) -> DataFrame:
    """Value -> code through the fitted dimension; null and unseen values give null."""
    d = dim.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    j = df.join(broadcast_checked(d), F.col(column) == F.col("__v"), "left").drop("__v")
    return j.withColumn(out or column, F.col("__code")).drop("__code")


def ordinal_encode(df: DataFrame, cols: Sequence[str], min_frequency: int = 80,
                   fit_on: DataFrame | None = None, suffix: str = "_code") -> tuple[DataFrame, dict]:
    """Encode each column; returns (encoded frame, {column: dimension}) (H1/H2).

    ``fit_on`` fits the codes on another table (e.g. the truth table) and applies them here."""
    dims = {}
    out = df
    for c in cols:
        dim = fit_ordinal(fit_on if fit_on is not None else df, c, min_frequency)
        dims[c] = dim
        out = apply_ordinal(out, c, dim, f"{c}{suffix}")
    return out, dims


def decode_map(dim: DataFrame) -> DataFrame:
    """(code, category) decode table: one label per code."""
    return dim.groupBy("code").agg(F.min("label").alias("category"))


def robust_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact median and IQR per column (H3): {col: (median, iqr)}."""
    lv = long_values(df, [], cols).where(F.col("value").isNotNull())
    q = exact_quantiles(lv, "column", "value", [0.25, 0.5, 0.75], ["q1", "med", "q3"]).collect()
    return {r["column"]: (r["med"], r["q3"] - r["q1"]) for r in q}


def robust_scale(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """(x - median) / IQR; a zero IQR divides by 1 (H3)."""
    stats = stats or robust_stats(df, cols)
    ex = {}
    for c in cols:
        med, iqr = stats.get(c, (None, None))
        if med is None:
            continue
        ex[c] = (F.col(c).cast("double") - F.lit(med)) / F.lit(iqr if iqr else 1.0)
    return df.withColumns(ex)


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; zero std divides by 1 (H4)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    ex = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        if m is None:
            continue
        ex[c] = (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)
    return df.withColumns(ex)


def encode_scale_frame(df: DataFrame, encode_cols: Sequence[str], scale_cols: Sequence[str],
                       min_frequency: int = 1) -> DataFrame:
    """Listed categorical columns to codes, the numeric rest robust-scaled."""
    enc, _ = ordinal_encode(df, encode_cols, min_frequency, suffix="__c")
    enc = enc.drop(*encode_cols).withColumnsRenamed({f"{c}__c": c for c in encode_cols})
    return robust_scale(enc, scale_cols)
