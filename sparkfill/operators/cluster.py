"""Clustering and reduction (H5-H7, H14, with E4, D19, D20).

Fitting uses MLlib (distributed KMeans / PCA on an assembled vector column).
The vector table is checkpointed once and reused by every k of the inertia curve.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.operators import clean, encode, order, profile
from sparkfill.operators.impute import registry
from sparkfill.session import cut_lineage, written


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one vector column (nulls kept as NaN)."""
    typed = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(typed)


def covariance_entries(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, cov) sample covariances on complete rows, one aggregate (H5's deterministic part)."""
    cc = df.select(*cols).na.drop()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = cc.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    lv = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "cov")
    return lv.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "cov")


def pca_reduce(df: DataFrame, key: str, cols: Sequence[str], variance: float | None = 0.95,
               k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PCA keeping the first n components reaching ``variance`` (or exactly ``k``) (H5).

    Returns (key + pc_0..pc_{n-1}, explained ratios (i, ratio, cum), loadings (column, component, loading)).
    Columns are centred first (MLlib's PCA does not centre)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = df.select(key, *[(F.col(c) - F.lit(means[c])).alias(c) for c in cols]).na.drop()
    vec = assemble(centred, cols)
    model = PCA(k=len(cols), inputCol="features", outputCol="pcs").fit(vec)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    spark = df.sparkSession
    rdf = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "i int, ratio double")
    cum = order.cumulative_variance(rdf, "i", "ratio", variance or 0.95)
    if k is None:
        acc, n = 0.0, 0
        for i, r in enumerate(ratios):
            acc += r
            if acc >= (variance or 0.95):
                n = i + 1
                break
        n = n or len(cols)
    else:
        n = k
    out = model.transform(vec).select(key, vector_to_array("pcs").alias("__p"))
    out = out.select(key, *[F.col("__p")[i].alias(f"pc_{i}") for i in range(n)])
    pc = model.pc.toArray()
    load = spark.createDataFrame([(c, j, float(pc[i, j])) for i, c in enumerate(cols) for j in range(len(cols))],
                                 "column string, component int, loading double")
    return out, cum, load


def kmeans_assign(df: DataFrame, key: str, cols: Sequence[str], k: int, seed: int = 42,
                  max_iter: int = 50) -> tuple[DataFrame, float]:
    """KMeans labels (H6); returns (key, cluster) and the inertia (within-cluster sum of squares)."""
    vec = assemble(df.select(key, *cols).na.drop(), cols)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(vec)
    return model.transform(vec).select(key, "cluster"), float(model.summary.trainingCost)


#: Rows from which first centres are drawn.
CENTRE_SAMPLE = 2000


def first_centres(rows: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ draws: each next centre with a chance in proportion to its squared distance from those before."""
    rng = np.random.default_rng(seed)
    centres = [rows[rng.integers(len(rows))]]
    while len(centres) < k:
        d = ((rows[:, None, :] - np.array(centres)[None]) ** 2).sum(-1).min(axis=1)
        centres.append(rows[rng.choice(len(rows), p=d / d.sum())] if d.sum() > 0 else rows[0])
    return np.array(centres)


def _side_by_side(centres: dict[int, np.ndarray]):
    """For every k, the sums and squared distances of the rows nearest to each centre."""
    def step(batches):
        d = next(iter(centres.values())).shape[1]
        total = {k: np.zeros((k, d + 2)) for k in centres}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            columns = np.ascontiguousarray(x.T)
            for k, c in centres.items():
                least, own = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                for i in range(k):
                    dist = np.zeros(len(x))
                    for j in range(d):
                        dist += (columns[j] - c[i, j]) ** 2
                    nearer = dist < least
                    least[nearer], own[nearer] = dist[nearer], i
                for i, weights in enumerate([None, *columns, least]):
                    total[k][:, i] += np.bincount(own, weights, k)
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), pa.array(list(t), pa.list_(pa.float64()))], names=["k", "c", "v"])

    return step


def lloyd_side_by_side(rows: DataFrame, centres: dict[int, np.ndarray], max_iter: int = 50, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Lloyd's rounds of several k at once: one scan of ``rows`` (x array) a round serves them all.

    A k that settled (no centre moves by ``tol``) takes no further part. Returns centres and inertia by k, as each
    fit alone would from the same centres; an empty cluster keeps its centre."""
    left, out = dict(centres), {}
    for rnd in range(max_iter + 1):
        each = rows.mapInArrow(_side_by_side(left), "k int, c int, v array<double>").select("k", "c", F.posexplode("v").alias("i", "v"))
        sums = {k: np.zeros((k, c.shape[1] + 2)) for k, c in left.items()}
        for r in each.groupBy("k", "c", "i").agg(F.sum("v").alias("v")).collect():
            sums[r.k][r.c, r.i] = r.v
        for k, t in sums.items():
            new = np.where(t[:, :1] > 0, t[:, 1:-1] / np.maximum(t[:, :1], 1), left[k])
            out[k] = (left[k], float(t[:, -1].sum()))
            if rnd == max_iter or np.sqrt(((new - left[k]) ** 2).sum(axis=1)).max() < tol:
                del left[k]
            else:
                left[k] = new
        if not left:
            break
    return out


def kmeans_inertia_curve(df: DataFrame, key: str, cols: Sequence[str], ks: Sequence[int] = range(1, 11),
                         seed: int = 42) -> DataFrame:
    """(k, inertia) for each k (H7), complete rows only. All k run side by side, so the table is scanned once
    a round; first centres are k-means++ draws from ``CENTRE_SAMPLE`` rows of least hash."""
    base = cut_lineage(df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).where(
        ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    sample = base.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(CENTRE_SAMPLE).select("x").collect()
    spark = df.sparkSession
    if not sample:
        return spark.createDataFrame([], "k int, inertia double")
    rows = np.array([r.x for r in sample])
    found = lloyd_side_by_side(base.select("x"), {k: first_centres(rows, k, seed + k) for k in ks})
    return spark.createDataFrame([(k, found[k][1]) for k in ks], "k int, inertia double")


def cluster_records(df: DataFrame, key: str, target: str, features: Sequence[str], method: str = "reduced",
                    selected: Sequence[str] | None = None, impute_method: str = "mean", seed: int = 42,
                    dense_limit: float = 0.10) -> dict:
    """Select, keep dense columns, impute, scale, (reduce), choose k by the elbow, cluster, score.

    ``method``: 'important' clusters on the selected columns, 'reduced' on PCA of the dense
    columns, anything else on PCA of the selected columns. Returns a dict with ``labels``
    (key, cluster), ``selected``, ``pca_columns``, ``k``, ``scores`` (davies_bouldin, calinski_harabasz)."""
    feats = [c for c in features if c != target]
    sel = list(selected) if selected is not None else feats
    ratios = clean.missing_ratios(df, feats)
    dense = [c for c in feats if ratios[c] <= dense_limit]
    use = sel if method == "important" else (dense if method == "reduced" else sel)
    filled = registry.impute_table(df.select(key, *use), use, impute_method)
    scaled = encode.robust_scale(filled, use)
    cols = use
    pca_cols: list[str] = []
    if method != "important":
        red, _, _ = pca_reduce(scaled, key, use, 0.95)
        pca_cols = [c for c in red.columns if c != key]
        scaled, cols = red, pca_cols
    scaled = cut_lineage(scaled)
    curve = kmeans_inertia_curve(scaled, key, cols, seed=seed)
    k = int(order.elbow_k(curve).first()["k"])
    k = max(k, 2)
    labels, _ = kmeans_assign(scaled, key, cols, k, seed)
    # both scores pass over it several times
    vec = written(scaled.join(labels, key).select(key, "cluster", F.array(*[F.col(c) for c in cols]).alias("v")), "clustered")
    db = profile.davies_bouldin(vec, key, "v", "cluster").first()[0]
    ch = profile.calinski_harabasz(vec, key, "v", "cluster").first()[0]
    return {"labels": labels, "selected": sel, "pca_columns": pca_cols, "k": k, "curve": curve,
            "scores": {"davies_bouldin": db, "calinski_harabasz": ch}}
