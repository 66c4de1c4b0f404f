"""Column-constant fills (I3): nop, mean, median, most_frequent.

Fill values come from one aggregate over all columns (unpivoted, so one shuffle
whatever the column count) and are attached as literals: the fitted state is a
handful of scalars, never data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import exact_quantiles
from sparkfill.functions.scalars import NUMERIC_TYPES, long_values

METHODS = ("nop", "mean", "median", "most_frequent")


def fill_values(df: DataFrame, cols: Sequence[str], method: str) -> dict:
    """Fitted fill value per column (None when a column has no value)."""
    types = dict(df.dtypes)
    num = [c for c in cols if types[c] in NUMERIC_TYPES]
    txt = [c for c in cols if c not in num]
    out: dict = {c: None for c in cols}
    if method == "nop" or not cols:
        return out
    if method == "mean":
        if num:
            row = df.agg(*[F.avg(c).alias(c) for c in num]).first()
            out.update(row.asDict())
        for c in txt:
            out[c] = most_frequent(df, [c])[c]
        return out
    if method == "median":
        if num:
            lv = long_values(df, [], num).where(F.col("value").isNotNull())
            q = exact_quantiles(lv, "column", "value", [0.5], ["med"]).collect()
            out.update({r["column"]: r["med"] for r in q})
        for c in txt:
            out[c] = most_frequent(df, [c])[c]
        return out
    if method == "most_frequent":
        return most_frequent(df, cols)
    raise ValueError(f"unknown constant method {method}")


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mode per column; ties go to the least value (numeric order for numbers)."""
    types = dict(df.dtypes)
    out: dict = {c: None for c in cols}
    for kind, group in (("double", [c for c in cols if types[c] in NUMERIC_TYPES]),
                        ("string", [c for c in cols if types[c] not in NUMERIC_TYPES])):
        if not group:
            continue
        lv = long_values(df, [], group, cast=kind).where(F.col("value").isNotNull())
        cnt = lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = cnt.groupBy("column").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("mode"))
        for r in best.collect():
            out[r["column"]] = r["mode"]
    return out


def apply_fill(df: DataFrame, values: dict, keep_type: bool = False) -> DataFrame:
    """coalesce(col, value) for each column with a fitted value; others unchanged.

    Numeric columns become double unless ``keep_type`` (mode fills keep the type)."""
    types = dict(df.dtypes)
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        if types[c] in NUMERIC_TYPES and keep_type:
            exprs[c] = F.coalesce(F.col(c), F.lit(v).cast(types[c]))
        elif types[c] in NUMERIC_TYPES:
            exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
        else:
            exprs[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(exprs) if exprs else df


def impute_constant(df: DataFrame, cols: Sequence[str], method: str = "mean") -> DataFrame:
    """Fill nulls of ``cols`` with a per-column constant (nop leaves them)."""
    return apply_fill(df, fill_values(df, cols, method), keep_type=(method == "most_frequent"))
