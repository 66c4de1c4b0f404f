"""Imputation strategies (I10-I13, I15, I16, I18): full table, selected features,
per cluster, side by side, and the benchmark grid.

Closed-form methods run for all clusters at once as one grouped aggregate (S12), and so do the
least-squares chains of ``ice`` (``grouped.py``); other model methods fit once per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import exact_quantiles
from sparkfill.functions.scalars import NUMERIC_TYPES
from sparkfill.operators import distance, sampling
from sparkfill.operators.impute import grouped, registry
from sparkfill.session import broadcast_checked, written

CLOSED_FORM = ("mean", "median", "most_frequent", "nop")
#: Methods whose models of all clusters come from the same aggregates.
GROUPED = ("ice", "sklearn_ice")


def group_fill_values(df: DataFrame, group: str, target: str, method: str) -> DataFrame:
    """(group, __fill) per-group constant of a closed-form method."""
    d = df.where(F.col(target).isNotNull())
    if method == "mean":
        return d.groupBy(group).agg(F.avg(target).alias("__fill"))
    if method == "median":
        return exact_quantiles(d, group, target, [0.5], ["__fill"])
    if method == "most_frequent":
        cnt = d.groupBy(group, target).agg(F.count(F.lit(1)).alias("n"))
        return cnt.groupBy(group).agg(F.min_by(target, F.struct((-F.col("n")).alias("n"), F.col(target))).alias("__fill"))
    if method == "nop":
        return d.select(group).distinct().withColumn("__fill", F.lit(None).cast("double"))
    raise ValueError(method)


def prefill_sparse_cluster(df: DataFrame, key: str, cluster: str, target: str, current: DataFrame,
                           current_cols: Sequence[str], seed: str = "prefill", limit: float = 0.9) -> DataFrame:
    """Where more than ``limit`` of a cluster's target is missing, fill n_missing - floor(limit n)
    random missing rows with the row mean of the other strategies' values (I12)."""
    st = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target).isNull()).alias("nm"))
    quotas = {r[cluster]: r["nm"] - int(r["n"] * limit) for r in st.collect() if r["nm"] > limit * r["n"]}
    if not quotas:
        return df
    miss = df.where(F.col(target).isNull() & F.col(cluster).isin(list(quotas))).select(key, cluster)
    chosen = sampling.sample_exact_per_group(miss, cluster, quotas, seed, key)
    rowmean = sum((F.col(c) for c in current_cols), F.lit(0.0)) / len(current_cols)
    fills = chosen.join(current.select(key, rowmean.alias("__pre")), key)
    t = dict(df.dtypes)[target]
    out = df.join(fills.select(key, "__pre"), key, "left")
    return out.withColumn(target, F.coalesce(F.col(target).cast("double" if t != "string" else t),
                                              F.col("__pre"))).drop("__pre")


def _only_large(df: DataFrame, sizes: DataFrame, cluster: str, min_size: int) -> DataFrame:
    """Rows of the clusters with more than ``min_size`` rows that miss something."""
    large = sizes.where((F.col("__size") > min_size) & (F.col("__nm") > 0)).select("__label")
    return df.join(broadcast_checked(large), F.col(cluster).eqNullSafe(F.col("__label")), "left_semi")


def impute_by_cluster(df: DataFrame, key: str, cluster: str, target: str, features: Sequence[str],
                      method: str = "mean", min_size: int = 150, knn_k: int = 5,
                      categorical: bool = False) -> DataFrame:
    """Fill ``target`` inside each cluster (I11): clusters with more than ``min_size`` rows use
    the main method, smaller ones k-NN on the features; clusters with nothing missing are untouched.
    Rows without a cluster are a cluster of their own; every row stays."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__size"),
                                    F.count_if(F.col(target).isNull()).alias("__nm"))
    sizes = sizes.withColumnRenamed(cluster, "__label")
    same = F.col(cluster).eqNullSafe(F.col("__label"))
    big = df.join(sizes, same).drop("__label")
    if method in CLOSED_FORM:
        fills = group_fill_values(df, cluster, target, method)
        out = big.join(fills.withColumnRenamed(cluster, "__label"), same, "left").drop("__label")
        out = out.withColumn("__main", F.when(F.col(target).isNull() & (F.col("__size") > min_size), F.col("__fill")))
        out = out.drop("__fill")
    elif method in GROUPED and not categorical and all(t in NUMERIC_TYPES for t in (dict(df.dtypes)[c] for c in [target, *features])):
        main = _only_large(df, sizes, cluster, min_size)
        filled = grouped.chained_by_cluster(main, key, cluster, [target, *[c for c in features if c != target]])
        out = big.join(filled.select(key, F.col(target).alias("__main")), key, "left")
    else:
        parts = None
        for r in sizes.where((F.col("__size") > min_size) & (F.col("__nm") > 0)).collect():
            sub = df.where(F.col(cluster).eqNullSafe(F.lit(r["__label"]))).select(key, target, *features)
            held = sub.agg(*[F.count(c).alias(c) for c in features]).first()
            known = [c for c in features if held[c]]  # a column without a value in the cluster tells nothing (B11)
            cfg = {"key": key, "categorical": [target] if categorical else []}
            filled = registry.impute_table(sub.select(key, target, *known), [target, *known], method, cfg).select(
                key, F.col(target).alias("__main"))
            parts = filled if parts is None else parts.unionByName(filled)
        out = big.join(parts, key, "left") if parts is not None else big.withColumn("__main", F.lit(None))
    small = big.select(key, cluster, target, "__size", *features)
    knn = distance.knn_fill(small, key, cluster, target, features, k=knn_k, categorical=categorical, only=F.col("__size") <= min_size)
    out = out.join(knn.select(key, F.col(target).alias("__knn")), key, "left")
    filled = F.when(F.col(target).isNotNull(), F.col(target).cast("double")) \
        .when(F.col("__size") > min_size, F.col("__main").cast("double")) \
        .otherwise(F.col("__knn").cast("double"))
    return out.withColumn(target, filled).drop("__size", "__nm", "__main", "__knn")


def impute_selected(df: DataFrame, key: str, target: str, selected: Sequence[str], method: str = "mean") -> DataFrame:
    """Impute using the selected features plus the target only."""
    sub = df.select(key, target, *[c for c in selected if c != target])
    return registry.impute_table(sub, [target] + [c for c in selected if c != target], method)


def impute_three_ways(df: DataFrame, key: str, target: str, features: Sequence[str], cluster_labels: DataFrame,
                      selected: Sequence[str] | None = None, method: str = "mean", mnar: bool = False,
                      round_codes: bool = False) -> DataFrame:
    """Full, selected and cluster strategies side by side (I13):
    (key, <t>_imputed_full, <t>_imputed_full_selected, <t>_imputed_cluster).

    ``cluster_labels`` is (key, cluster); MNAR indicators go to the last two strategies only."""
    cols = [target] + [c for c in features if c != target]
    full = registry.impute_table(df.select(key, *cols), cols, method).select(
        key, F.col(target).cast("double").alias(f"{target}_imputed_full"))
    base = df
    if mnar:
        base = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})
    sel = list(selected) if selected is not None else [c for c in features if c != target]
    s = impute_selected(base, key, target, sel + ([f"{c}_missing" for c in cols] if mnar else []), method).select(
        key, F.col(target).cast("double").alias(f"{target}_imputed_full_selected"))
    current = full.join(s, key)
    cl = base.join(cluster_labels.select(key, "cluster"), key)
    cl = prefill_sparse_cluster(cl, key, "cluster", target, current,
                                [f"{target}_imputed_full", f"{target}_imputed_full_selected"])
    cl = written(cl.select(key, "cluster", target, *sel), "clusters")
    c = impute_by_cluster(cl, key, "cluster", target, sel, method).select(
        key, F.col(target).alias(f"{target}_imputed_cluster"))
    out = full.join(s, key).join(c, key)
    if round_codes:
        out = out.withColumns({n: F.rint(F.col(n)) for n in out.columns if n != key})
    return out


def strategies_for_targets(df: DataFrame, truth: DataFrame, key: str, targets: Sequence[str],
                           features: Sequence[str], cluster_labels: DataFrame, categorical: Sequence[str] = (),
                           method: str = "mean") -> DataFrame:
    """I13 for every target, stacked long with truth and the combined (row-mean) fill (I15, I16):
    (target, key, imputed_full, imputed_full_selected, imputed_cluster, truth, combined)."""
    out = None
    for t in targets:
        tw = impute_three_ways(df, key, t, features, cluster_labels, method=method, round_codes=t in categorical)
        tw = tw.select(F.lit(t).alias("target"), key,
                       F.col(f"{t}_imputed_full").alias("imputed_full"),
                       F.col(f"{t}_imputed_full_selected").alias("imputed_full_selected"),
                       F.col(f"{t}_imputed_cluster").alias("imputed_cluster"))
        tw = tw.join(truth.select(key, F.col(t).cast("double").alias("truth")), key, "left")
        comb = (F.col("imputed_full") + F.col("imputed_full_selected") + F.col("imputed_cluster")) / 3
        tw = tw.withColumn("combined", F.rint(comb) if t in categorical else comb)
        out = tw if out is None else out.unionByName(tw)
    return out


def subpopulation_impute(df: DataFrame, key: str, target: str, features: Sequence[str], selection=None, clustering: str | None = None,
                         mnar: bool = False, method: str = "mean", min_size: int = 150) -> dict:
    """One run of the benchmark (I18): select features, form clusters, fill inside them.

    ``selection``: None (all features), the features themselves, or a method of ``select_features``.
    ``clustering``: None (no clusters), a column whose values are the clusters, or a method of
    ``cluster_records``. ``mnar`` adds an indicator of missing cells for the target and every feature.
    Returns ``filled`` (key, target), ``selected``, ``labels`` (key, cluster; None without clusters).
    """
    from sparkfill.operators import cluster, select
    features = [c for c in features if c != target]
    if selection is None or isinstance(selection, (list, tuple)):
        chosen = list(features if selection is None else selection)
    else:
        chosen, _ = select.select_features(df, key, target, features, selection, mnar=False)
        chosen = list(chosen) or features
    labels = None
    if clustering in df.columns:
        labels = df.select(key, F.col(clustering).alias("cluster"))
    elif clustering is not None:
        labels = cluster.cluster_records(df, key, target, features, method=clustering, selected=chosen)["labels"]
    base = df.select(key, target, *chosen)
    used = list(chosen)
    if mnar:
        marks = {f"{c}_missing": F.col(c).isNull().cast("int") for c in chosen}
        base, used = base.withColumns(marks), [*chosen, *marks]
    if labels is None:
        filled = registry.impute_table(base, [target, *used], method, {"key": key}).select(key, target)
    else:
        base = base.join(labels.withColumnRenamed("cluster", "__cluster"), key, "left")
        filled = impute_by_cluster(base, key, "__cluster", target, used, method, min_size).select(key, target)
    return {"filled": filled, "selected": chosen, "labels": labels}


def benchmark_imputers(df: DataFrame, key: str, target: str, methods: Sequence[str], configs: Sequence[tuple],
                       seeds: Sequence[int], features: Sequence[str] = (), min_size: int = 150) -> DataFrame:
    """Methods x (selection, clustering, mnar) x seeds on simulated maskings (I18):
    (method, selection, clustering, mnar, seed, target, n_selected, n_clusters, mae, n).

    Each cell of the grid is a run of :func:`subpopulation_impute` on the masked table, scored on what was masked."""
    out = None
    for seed in seeds:
        masked, hidden = sampling.mask_random(df, target, f"sim{seed}", key)
        masked = written(masked, "masked")  # every run of the grid reads it several times
        truth = written(df.join(hidden, key).select(key, F.col(target).cast("double").alias("__truth")), "truth")
        for method in methods:
            for selection, clustering, mnar in configs:
                run = subpopulation_impute(masked, key, target, features, selection, clustering, mnar, method, min_size)
                sc = run["filled"].join(truth, key).agg(
                    F.avg(F.abs(F.col(target).cast("double") - F.col("__truth"))).alias("mae"),
                    F.count(F.lit(1)).alias("n"))
                clusters = run["labels"].select("cluster").distinct().count() if run["labels"] is not None else 1
                name = "all" if selection is None else selection if isinstance(selection, str) else "+".join(selection)
                row = sc.select(F.lit(method).alias("method"), F.lit(name).alias("selection"),
                                F.lit(clustering or "none").alias("clustering"), F.lit(mnar).alias("mnar"),
                                F.lit(seed).alias("seed"), F.lit(target).alias("target"),
                                F.lit(len(run["selected"])).alias("n_selected"), F.lit(clusters).alias("n_clusters"), "mae", "n")
                out = row if out is None else out.unionByName(row)
    return out
