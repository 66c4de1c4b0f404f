"""The preparation chain (I21): align, clean, look up, prune, keep rows with truth, encode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sparkfill.operators import clean, encode, joins


def prepare_records(raw: DataFrame, truth: DataFrame, lookup: DataFrame | None, key: str = "row_id",
                    lookup_on: str | None = None, truth_sentinels: Mapping[str, Sequence] | None = None,
                    sentinels: Mapping[str, Sequence] | None = None, scale: Mapping[str, tuple] | None = None,
                    drop: Sequence[str] = (), encode_cols: Sequence[str] = (), min_frequency: int = 80
                    ) -> tuple[DataFrame, DataFrame, dict]:
    """Returns (prepared records, cleaned truth, {column: code dimension})."""
    t = clean.sentinel_to_null(truth, truth_sentinels) if truth_sentinels else truth
    t = clean.drop_nulls(t)
    df = raw
    for c, (factor, out) in (scale or {}).items():
        df = clean.unit_scale(df, c, factor, out)
        if out != c:
            df = df.drop(c)
    if lookup is not None:
        df = joins.lookup_left_join(df, lookup, lookup_on)
    df = clean.drop_by_rule(df, lambda c: True, drop)
    df = joins.semi_join_truth(df, t, key)
    if sentinels:
        df = clean.sentinel_to_null(df, sentinels)
    dims = {}
    if encode_cols:
        df, dims = encode.ordinal_encode(df, encode_cols, min_frequency, suffix="__code")
        df = df.drop(*encode_cols).withColumnsRenamed({f"{c}__code": c for c in encode_cols})
    return df, t, dims
