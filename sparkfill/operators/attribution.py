"""Per-row additive attributions of a decision-tree prediction (H17): exact Shapley values.

The value of a set of features is what the tree expects if only they are known: at a split on a known
feature the row's side is taken, at any other both, by the share of training rows that went there.
A leaf then counts with the product, over the features of its path, of 1 or 0 (known: does the row
meet all of the path's splits on it?) or of the shares (unknown). So a feature's Shapley value is a
sum over leaves, in which the other features of the path enter through a polynomial whose k-th
coefficient gathers all sets of k known ones; its product is built feature by feature, and no set
is ever enumerated. base (nothing known) + the credits = the prediction.

The paths are a table of the model, of one entry a leaf; rows pass it in batches, and nothing is shuffled.
A row enters only by the sides it takes at the tree's splits, so of the rows of a batch that take
the same sides everywhere one is worked out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.operators.cluster import assemble

_IF = re.compile(r"^\s*If \(feature (\d+) <= (\S+)\)")
_PRED = re.compile(r"^\s*Predict: (\S+)")


def parse_tree(debug: str) -> dict:
    """Nested dict of the tree in pre-order: {'feature', 'at', 'left', 'right'} or {'leaf': index, 'value'}; numeric splits only."""
    lines = [ln for ln in debug.splitlines()[1:] if ln.strip()]
    pos, leaf = 0, 0

    def node():
        nonlocal pos, leaf
        line = lines[pos]
        m = _IF.match(line)
        if m:
            pos += 1
            left = node()
            pos += 1          # the matching Else line
            right = node()
            return {"feature": int(m.group(1)), "at": float(m.group(2)), "left": left, "right": right}
        m = _PRED.match(line)
        if m:
            pos += 1
            out = {"leaf": leaf, "value": float(m.group(1))}
            leaf += 1
            return out
        raise ValueError(f"cannot parse tree line: {line!r}")

    return node()


def leaf_paths(tree: dict, leaf_rows: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """For each leaf its value and, for each feature of its path, (feature, low, high, share): the row is on the path
    if low < x <= high, and ``share`` of the training rows are where the feature is unknown."""
    def count(nd):
        nd["n"] = leaf_rows.get(nd["leaf"], 0) if "leaf" in nd else count(nd["left"]) + count(nd["right"])
        return nd["n"]

    count(tree)
    out = []

    def walk(nd, path):
        if "leaf" in nd:
            out.append((nd["value"], [(f, *p) for f, p in sorted(path.items())]))
            return
        f = nd["feature"]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((nd["left"], (low, min(high, nd["at"]))), (nd["right"], (max(low, nd["at"]), high))):
            part = child["n"] / nd["n"] if nd["n"] else 0.5
            walk(child, {**path, f: (*bounds, share * part)})

    walk(tree, {})
    return out


def shapley(paths: list, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The value without any feature, and the credits (row, feature)."""
    out, base = np.zeros(x.shape), 0.0
    for value, path in paths:
        m = len(path)
        base += value * float(np.prod([share for *_, share in path]))
        if not m:
            continue
        weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        # a null goes right, as any comparison with it fails
        met = np.stack([~(x[:, f] <= low) & ((x[:, f] <= high) | np.isinf(high)) for f, low, high, _ in path], axis=1).astype(float)
        share = np.array([s for *_, s in path])
        for i, (f, *_) in enumerate(path):
            sets = np.zeros((len(x), m))
            sets[:, 0] = 1.0
            for j in range(m):
                if j != i:  # times (share + met t)
                    sets[:, 1:] = sets[:, 1:] * share[j] + sets[:, :-1] * met[:, j : j + 1]
                    sets[:, 0] *= share[j]
            out[:, f] += value * (met[:, i] - share[i]) * (sets @ weight)
    return base, out


def cells(paths: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each set of rows of ``x`` that lie between the same bounds of the paths, and each row's place among them."""
    codes = np.zeros(x.shape, np.int32)
    for f in range(x.shape[1]):
        at = np.unique([b for _, path in paths for g, *bounds, _ in path if g == f for b in bounds if np.isfinite(b)])
        codes[:, f] = np.searchsorted(at, x[:, f], "left")  # how many bounds are below it
        codes[np.isnan(x[:, f]), f] = -1
        codes[x[:, f] == -np.inf, f] = -2
    _, one, place = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    return one, place.reshape(-1)


def tree_attribution(model, train: DataFrame, rows: DataFrame, features: Sequence[str], label: str,
                     key: str) -> DataFrame:
    """(key, base, attr_<feature>..., pred) for every row of ``rows`` (regression tree with numeric splits)."""
    model.setLeafCol("__leaf")
    counted = model.transform(assemble(train, features)).groupBy("__leaf").count().collect()
    paths = leaf_paths(parse_tree(model.toDebugString), {int(r["__leaf"]): r["count"] for r in counted})
    features = list(features)

    def credit(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
            one, place = cells(paths, x)
            base, credits = shapley(paths, x[one])
            credits = credits[place]
            cols = [batch.column(key), pa.array(np.full(len(x), base)), *[pa.array(credits[:, i]) for i in range(len(features))], batch.column("pred")]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "base", *[f"attr_{f}" for f in features], "pred"])

    p = model.transform(assemble(rows.select(key, *features), features))
    p = p.select(key, *[F.col(f).cast("double").alias(f) for f in features], F.col("prediction").alias("pred"))
    kinds = [f"`{key}` {dict(rows.dtypes)[key]}", "base double", *[f"`attr_{f}` double" for f in features], "pred double"]
    return p.mapInArrow(credit, ", ".join(kinds))
