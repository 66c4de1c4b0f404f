"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``. Modules under ``sparkfill.plans``
register themselves with :func:`query`; ``__spark_entry__`` reads the two dicts.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "q_sources", "q_clean", "q_joins", "q_profile", "q_order", "q_scalars",
    "q_encode", "q_distance", "q_models", "q_impute", "q_synth", "q_insight",
)


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"sparkfill.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"sparkfill.plans.{m}":
                raise
