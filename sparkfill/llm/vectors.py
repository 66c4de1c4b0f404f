"""What the operators on embeddings share: whole vectors as integers, in numpy and back."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of larger size have squared distances that might not fit a long; see :func:`quantised`.
LIMIT = 1 << 26


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, q`` and the columns ``keep``: ``q`` is the array of ``floor(scale * x)``, ``x`` as double.

    Left out: null vectors, vectors with a null or non-finite component, and vectors with an
    integer beyond ``LIMIT`` either way (of these, sums of squares could leave a long).
    """
    x = F.col("v").cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    own = own.where(F.col("v").isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c * scale) <= LIMIT, F.lit(False)) & ~F.isnan(c)))
    return own.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("q"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def first_by(rows: DataFrame, n: int, *order: Column) -> list[list[int]]:
    """The vectors of the ``n`` first rows with an id; equal ids by their components."""
    return [r.q for r in rows.where(F.col("vec_id").isNotNull()).orderBy(*order, "q").limit(n).select("q").collect()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def floor_means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise ``floor(sum / count)``; where the count is 0, what was before."""
    n = np.maximum(counts, 1)[..., None]
    return np.where(counts[..., None] > 0, np.floor_divide(sums, n), before)


def summed(partial: DataFrame, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of ``(grp, n, total array)`` rows, as arrays ``groups`` and ``groups x width``.

    What reaches the driver is ``groups x (width + 1)`` numbers, whatever the input.
    """
    each = partial.select("grp", F.posexplode(F.concat(F.array("n"), "total")).alias("pos", "v"))
    sums, counts = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64)
    for r in each.groupBy("grp", "pos").agg(F.sum("v").alias("v")).collect():
        if r.pos:
            sums[r.grp, r.pos - 1] = r.v
        else:
            counts[r.grp] = r.v
    return sums, counts


def exact_in_float(largest: int, width: int) -> bool:
    """Whether sums of ``width`` squared differences of integers up to ``largest`` are exact as doubles."""
    return width * (2 * largest) ** 2 < 1 << 53


def key_limit(entries: int, width: int) -> int:
    """The largest component for which ``distance * entries + entry`` fits a 64-bit integer."""
    return math.isqrt((1 << 62) // (entries * width)) // 2
