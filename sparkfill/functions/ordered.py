"""Exact order statistics without a single-partition window.

A global ``row_number() over (order by x)`` or an exact ``percentile`` pulls a
whole column (or group) into one task. Here the column is first reduced to its
distinct values with counts (map-side combine absorbs hot values), cut into
buckets at approximate split points, summed cumulatively inside each bucket,
and shifted by the exclusive running total of the earlier buckets (a table of
``groups x buckets`` rows). The result is exact; only the bucket boundaries are
approximate, and they only affect balance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfill.session import broadcast_checked, written

N_BUCKETS = 64


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def cumulative(df: DataFrame, group_cols, order_col: str, weight_col: str,
               n_buckets: int = N_BUCKETS) -> DataFrame:
    """Add ``cum_end`` (sum of ``weight_col`` over rows with order <= this row, per group)
    and ``cum_start`` (= cum_end - weight). ``(group_cols, order_col)`` must be unique
    and ``order_col`` numeric (use :func:`distinct_counts` first)."""
    g = _as_list(group_cols)
    gk = g if g else ["__g"]
    d = df if g else df.withColumn("__g", F.lit(0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = d.groupBy(*gk).agg(
        F.percentile_approx(F.col(order_col).cast("double"), probs, 1000).alias("__splits"))
    d = d.join(broadcast_checked(splits), gk)
    d = d.withColumn("__b", F.size(F.filter("__splits", lambda s: s < F.col(order_col).cast("double"))))
    d = d.drop("__splits")
    w = (Window.partitionBy(*gk, "__b").orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__local", F.sum(weight_col).over(w))
    tot = d.groupBy(*gk, "__b").agg(F.sum(weight_col).alias("__btot"))
    wo = Window.partitionBy(*gk).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("__off", F.coalesce(F.sum("__btot").over(wo), F.lit(0))).drop("__btot")
    d = d.join(broadcast_checked(tot), gk + ["__b"])
    d = (d.withColumn("cum_end", F.col("__off") + F.col("__local"))
          .withColumn("cum_start", F.col("cum_end") - F.col(weight_col))
          .drop("__off", "__local", "__b"))
    return d if g else d.drop("__g")


def distinct_counts(df: DataFrame, group_cols, value_col: str, out: str = "n") -> DataFrame:
    """(group, value, n) over non-null values; partial aggregation before the shuffle."""
    g = _as_list(group_cols)
    return (df.where(F.col(value_col).isNotNull())
              .groupBy(*g, value_col).agg(F.count(F.lit(1)).alias(out)))


def dense_codes(df: DataFrame, group_cols, value_col: str, out: str = "code") -> DataFrame:
    """0-based dense rank of each distinct value in ascending order, per group.

    Works for any orderable type: strings are ranked through their own order
    by first ranking on a numeric surrogate is not possible, so non-numeric
    values use a sort-based path on the distinct table.
    """
    g = _as_list(group_cols)
    d = df.where(F.col(value_col).isNotNull()).select(*g, value_col).distinct()
    numeric = dict(d.dtypes)[value_col] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    if numeric:
        d = d.withColumn("__one", F.lit(1))
        c = cumulative(d, g, value_col, "__one")
        return c.select(*g, value_col, (F.col("cum_end") - 1).cast("int").alias(out))
    # strings: range-partition the distinct values and number them per partition,
    # then shift by the running count of earlier partitions (no single-task sort).
    return _dense_codes_sorted(d, g, value_col, out)


def _dense_codes_sorted(d: DataFrame, g: list[str], value_col: str, out: str) -> DataFrame:
    keys = g + [value_col]
    n_parts = max(1, d.sparkSession.sparkContext.defaultParallelism)
    r = (d.repartitionByRange(n_parts, *keys)
          .withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy("__pid", *g).orderBy(value_col)
    r = r.withColumn("__lrn", F.row_number().over(w))
    tot = r.groupBy("__pid", *g).agg(F.count(F.lit(1)).alias("__n"))
    wo = (Window.partitionBy(*g).orderBy("__pid") if g else Window.orderBy("__pid")).rowsBetween(
        Window.unboundedPreceding, -1)
    tot = tot.withColumn("__off", F.coalesce(F.sum("__n").over(wo), F.lit(0))).drop("__n")
    r = r.join(broadcast_checked(tot), ["__pid"] + g)
    return r.select(*g, value_col, (F.col("__off") + F.col("__lrn") - 1).cast("int").alias(out))


def exact_quantiles(df: DataFrame, group_cols, value_col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles (= ``percentile``/``quantile_cont``), exact, one row per group.

    Output columns: group cols + one double per probability (``names`` or q<i>)."""
    g = _as_list(group_cols)
    gk = g if g else ["__g"]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    base = df if g else df.withColumn("__g", F.lit(0))
    base = base.select(*gk, F.col(value_col).cast("double").alias("__x"))
    if _few_distinct(base, gk):
        # the built-in exact percentile keeps one (value -> count) map per group: bounded here
        arr = F.percentile("__x", [float(p) for p in probs])
        res = base.groupBy(*gk).agg(arr.alias("__q")).select(
            *gk, *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])
        if not g:
            res = res.drop("__g")
            res = df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names]) \
                .unionByName(res).agg(*[F.max(n).alias(n) for n in names])
        return res
    cnt = written(distinct_counts(base, gk, "__x", "__n"), "counts")  # splits, sums and look-up each read it
    cum = cumulative(cnt, gk, "__x", "__n")
    totals = cnt.groupBy(*gk).agg(F.sum("__n").alias("__tot"))
    spark = df.sparkSession
    pr = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "__pi int, __p double")
    targets = (totals.crossJoin(F.broadcast(pr))
               .withColumn("__pos", F.col("__p") * (F.col("__tot") - 1))
               .withColumn("__lo", F.floor("__pos"))
               .withColumn("__hi", F.ceil("__pos")))
    # each needed rank (lo and hi) is matched to the distinct value that covers it
    need = targets.select(*gk, "__pi", "__pos", "__lo", F.col("__lo").alias("__r"), F.lit(0).alias("__side")) \
        .unionByName(targets.select(*gk, "__pi", "__pos", "__lo", F.col("__hi").alias("__r"), F.lit(1).alias("__side")))
    need = broadcast_checked(need)
    hit = cum.join(need, [cum[c] == need[c] for c in gk] + [
        need["__r"] >= cum["cum_start"], need["__r"] < cum["cum_end"]])
    hit = hit.select(*[cum[c] for c in gk], "__pi", "__pos", "__lo", "__side", "__x")
    piv = (hit.groupBy(*gk, "__pi", "__pos", "__lo")
              .agg(F.max(F.when(F.col("__side") == 0, F.col("__x"))).alias("__vlo"),
                   F.max(F.when(F.col("__side") == 1, F.col("__x"))).alias("__vhi")))
    piv = piv.withColumn("__q", F.col("__vlo") + (F.col("__pos") - F.col("__lo")) * (F.col("__vhi") - F.col("__vlo")))
    res = piv.groupBy(*gk).agg(*[F.max(F.when(F.col("__pi") == i, F.col("__q"))).alias(nm)
                                 for i, nm in enumerate(names)])
    if not g:
        res = res.drop("__g")
        # keep a row even when the column is empty
        res = spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names]).unionByName(res) \
            .agg(*[F.max(n).alias(n) for n in names])
    return res


# a group's exact-percentile state is one (value -> count) map: about 16 bytes per distinct value,
# so groups estimated below half this bound stay well under 16 MB; larger ones take the bucketed path
EXACT_PERCENTILE_DISTINCT = 1_000_000


def _few_distinct(base: DataFrame, gk: list[str]) -> bool:
    """True when every group has at most EXACT_PERCENTILE_DISTINCT distinct values
    (HyperLogLog estimate with a 2x margin), so an exact in-memory percentile is safe."""
    est = base.groupBy(*gk).agg(F.approx_count_distinct("__x", 0.02).alias("__d")).agg(F.max("__d")).first()[0]
    return (est or 0) * 2 <= EXACT_PERCENTILE_DISTINCT


def quantile_expr_cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
