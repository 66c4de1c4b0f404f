"""Operator 11, centroid clustering with Ptolemaic pivots.

Vectors are integers. The pivots of the first round are the first centroids, those of all later
ones the centroids that it ends with; these stay fixed, so the distance of every vector to every
pivot is computed once and stored beside it. For a vector x, a centroid c and a pair of pivots
p, s, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

from stored numbers alone. In each round the fixed pairs (pivots of neighbouring numbers, and each
with its nearest) raise these bounds; the exact distance to the centroid of the least bound is an
upper one; and centroids whose bound is above it are out. Bounds are floating point and rounded
down by more than the error that they can have, so no nearest centroid and no tie is lost. The
survivors are checked in integers. How many survive is a matter of the data: where clusters
overlap, as in noise of many dimensions, nearly all do; the result is the same.

A round is one pass: each task assigns its vectors and sums them by centroid, and what the driver
gets is ``k x dims`` numbers. Vectors and their pivot distances lie in the shared folder.

Defined results: vectors that are null, of another length, or with null or non-finite components
are left out, and those with an integer beyond 2^26 (see ``vectors.quantised``); a null id is
assigned like any other, but never starts a centroid; repeated rows count as rows of their own, and
start centroids of their own if their hash is among the least, equal ids by their components;
fewer vectors with an id than ``k`` give as many centroids; ties go to the smaller number; an
empty table (or one without such vectors) gives an empty table. Other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.vectors import first_by, floor_means, matrix, quantised, summed
from sparkfill.session import shared_path

#: Rows that are bounded and checked at once.
BLOCK = 2048
#: More than any rounding error of a bound, relative to its two products.
SLACK = 2.0**-46

_PREPARED = "vec_id long, q array<long>, pivots array<double>"


class Pivots:
    """Fixed pivot pairs, the distances between them, and the bounds that follow for centroids."""

    def __init__(self, pivots: np.ndarray, per_pivot: int = 2):
        self.pivots = pivots
        m = len(pivots)
        apart = _exact(pivots[:, None, :], pivots[None, :, :])
        chosen = {(i, (i + 1) % m) for i in range(m)}
        for i in range(m):
            near = [j for j in np.argsort(apart[i], kind="stable").tolist() if apart[i, j] > 0]
            chosen.update((i, j) for j in near[:per_pivot])
        self.pairs = sorted({(min(p), max(p)) for p in chosen if apart[p] > 0})
        self.apart = np.sqrt(apart.astype(float))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(_exact(x[:, None, :], self.pivots[None, :, :]).astype(float))

    def cached(self, x: np.ndarray) -> np.ndarray:
        """The distances of many vectors, block by block."""
        return np.concatenate([np.empty((0, len(self.pivots))), *(self.distances(x[a : a + BLOCK]) for a in range(0, len(x), BLOCK))])

    def bounds(self, of_vectors: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """For each vector and centroid, a number that is never above their squared distance."""
        least = np.zeros((len(of_vectors), len(of_centroids)))
        for p, s in self.pairs:
            a = of_vectors[:, p, None] * of_centroids[None, :, s]
            b = of_vectors[:, s, None] * of_centroids[None, :, p]
            np.maximum(least, (np.abs(a - b) - (a + b) * SLACK) / self.apart[p, s], out=least)
        return least * least * (1 - SLACK)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every row, and how many distances were computed."""
    of_centroids = pivots.distances(centroids)
    label, distance, checked = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    for a in range(0, len(x), BLOCK):
        own, rows = x[a : a + BLOCK], np.arange(min(BLOCK, len(x) - a))
        least = pivots.bounds(cached[a : a + BLOCK], of_centroids)
        first = np.argmin(least, axis=1)
        exact = np.full(least.shape, np.iinfo(np.int64).max)
        exact[rows, first] = upper = _exact(own, centroids[first])
        open_ = least <= (upper * (1 + SLACK))[:, None]
        open_[rows, first] = False
        i, c = np.nonzero(open_)
        for at in range(0, len(i), 8 * BLOCK):
            some, of = i[at : at + 8 * BLOCK], c[at : at + 8 * BLOCK]
            exact[some, of] = _exact(own[some], centroids[of])
        checked += len(rows) + len(i)
        label[a : a + BLOCK] = best = np.argmin(exact, axis=1)  # the first of equals is the smaller number
        distance[a : a + BLOCK] = exact[rows, best]
    return label, distance, checked


def _with_pivots(pivots: Pivots, dims: int):
    def add(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix(batch.column("q"), dims)
            d = pivots.cached(x)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("q"),
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))],
                names=["vec_id", "q", "pivots"])

    return add


def _assigned(batches, centroids: np.ndarray, pivots: Pivots):
    for batch in batches:
        x = matrix(batch.column("q"), centroids.shape[1])
        cached = batch.column("pivots").flatten().to_numpy().reshape(len(x), -1) if "pivots" in batch.schema.names else pivots.cached(x)
        yield batch.column("vec_id"), x, *assign(x, cached, centroids, pivots)


def _sums(centroids: np.ndarray, pivots: Pivots):
    def add(batches):
        k, dims = centroids.shape
        sums, counts, checked = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for _, x, label, _, n in _assigned(batches, centroids, pivots):
            np.add.at(sums, label, x)
            counts += np.bincount(label, minlength=k)
            checked += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["grp", "n", "total"])

    return add


def _labels(centroids: np.ndarray, pivots: Pivots):
    def label(batches):
        for vec_id, _, own, distance, checked in _assigned(batches, centroids, pivots):
            first = np.zeros(len(own), np.int64)
            first[:1] = checked
            yield pa.RecordBatch.from_arrays([vec_id, pa.array(own, pa.int32()), pa.array(distance), pa.array(first)], names=["vec_id", "cluster", "distance", "checked"])

    return label


def cluster_vectors(vectors: DataFrame, k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every kept vector, and the final centroids.

    A further column ``checked`` counts exact distances of the last assignment (its sum over all
    rows; single values stand for a batch): ``k`` a row would be no pruning at all.
    """
    spark = vectors.sparkSession
    kept = quantised(vectors, scale, id_col, vector_col).where(F.size("q") == dims)
    starts = first_by(kept, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.col("vec_id"))
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, checked long"), []
    centroids = np.array(starts, np.int64)
    pivots = Pivots(centroids)

    def moved(of: DataFrame) -> np.ndarray:
        sums, counts = summed(of.mapInArrow(_sums(centroids, pivots), "grp int, n long, total array<long>"), len(centroids), dims)
        return floor_means(sums, counts, centroids)

    if rounds:
        centroids = moved(kept)
        pivots = Pivots(centroids)
    path = shared_path(spark, "pivot-distances")
    kept.mapInArrow(_with_pivots(pivots, dims), _PREPARED).write.parquet(path)
    ready = spark.read.schema(_PREPARED).parquet(path)
    for _ in range(rounds - 1):
        centroids = moved(ready)
    out = shared_path(spark, "clusters")
    ready.mapInArrow(_labels(centroids, pivots), "vec_id long, cluster int, distance long, checked long").write.parquet(out)
    return spark.read.parquet(out), centroids.tolist()


def digest(vectors: DataFrame, **options) -> DataFrame:
    """Each vector with its cluster, the inertia of its cluster and of all, and a hash of its centroid."""
    found, centroids = cluster_vectors(vectors, **options)
    of_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = F.coalesce(F.sum("cluster_inertia"), F.lit(0))
    inertia = of_cluster.agg(total.alias("t")).first().t
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    sha = F.array(*map(F.lit, shas))[F.col("cluster")]
    # one row a centroid, so the side is bounded by k
    return found.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), sha.alias("centroid_sha256"))
