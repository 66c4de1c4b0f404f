"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (comparison-friendly output)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in ex]


def long_values(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                name: str = "column", value: str = "value", cast: str = "double") -> DataFrame:
    """Unpivot ``cols`` into (ids..., column, value) with a common type."""
    cast_df = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return cast_df.unpivot(list(ids), list(cols), name, value)


def is_null_int(c) -> Column:
    return col(c).isNull().cast("int")


def clip(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def nan_to_null(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def fmt2(x) -> Column:
    return F.format_string("%.2f", col(x))
