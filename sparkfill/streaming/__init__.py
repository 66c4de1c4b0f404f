"""Row-local operators on streaming DataFrames.

The reference has no streaming work. Fills whose fitted state is a handful of
constants (or a small dimension table) apply unchanged to a stream: fit on a
batch table, then apply the same expressions to ``readStream`` input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkfill.operators import clean
from sparkfill.operators.impute import simple


def fill_stream(spark: SparkSession, fitted_on: DataFrame, source_dir: str, cols: Sequence[str],
                method: str = "mean", fmt: str = "parquet", sentinels: dict | None = None) -> DataFrame:
    """A streaming DataFrame over ``source_dir`` with nulls of ``cols`` filled by constants
    fitted on the batch table ``fitted_on`` (sentinels mapped to null first)."""
    values = simple.fill_values(fitted_on, list(cols), method)
    stream = spark.readStream.format(fmt).schema(fitted_on.schema).load(source_dir)
    if sentinels:
        stream = clean.sentinel_to_null(stream, sentinels)
    return simple.apply_fill(stream, values, keep_type=(method == "most_frequent"))
