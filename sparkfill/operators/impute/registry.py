"""Imputer registry (I1, I2): name -> ``fn(df, cols, cfg) -> DataFrame``.

Every method fills the nulls of ``cols`` and keeps observed cells, the key and the
row set unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from sparkfill.operators.impute import simple

_REGISTRY: dict[str, Callable] = {}


def register(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


for _m in simple.METHODS:
    register(_m)(lambda df, cols, cfg=None, _m=_m: simple.impute_constant(df, cols, _m))


def list_imputers() -> list[str]:
    _load_model_methods()
    return sorted(_REGISTRY)


def get(name: str) -> Callable:
    _load_model_methods()
    if name not in _REGISTRY:
        raise KeyError(f"unknown imputer {name}; available: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def impute_table(df: DataFrame, cols: Sequence[str], method: str = "mean", cfg: dict | None = None) -> DataFrame:
    """Fill every null of ``cols`` with the chosen method."""
    return get(method)(df, list(cols), cfg or {})


def _load_model_methods() -> None:
    # model-based methods register themselves on import
    import importlib
    for m in ("chained", "lowrank"):
        try:
            importlib.import_module(f"sparkfill.operators.impute.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"sparkfill.operators.impute.{m}":
                raise
