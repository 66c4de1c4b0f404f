"""Profiling aggregates.

Every multi-column profile is one aggregate (or one unpivot + one grouped
aggregate), never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfill.functions.ordered import exact_quantiles
from sparkfill.functions.scalars import long_values
from sparkfill.session import broadcast_checked, cut_lineage


def missing_ratio(df: DataFrame, cols: Sequence[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """(column, missing_pct) percent null per column, > 0 only, descending."""
    cols = list(cols or df.columns)
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    lv = one.unpivot([], cols, "column", "missing_pct")
    if not keep_zero:
        lv = lv.where(F.col("missing_pct") > 0)
    return lv.orderBy(F.desc("missing_pct"), "column")


def group_missingness(df: DataFrame, group: str, target: str) -> DataFrame:
    """(group, n, n_missing, missing_share) of a target per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(target).isNull()).alias("n_missing"),
        F.avg(F.col(target).isNull().cast("double")).alias("missing_share"))


def numeric_summary(df: DataFrame, cols: Sequence[str], exact_median: bool = True) -> DataFrame:
    """(column, mean, std, min, max, median) per numeric column, nulls skipped (D3)."""
    lv = long_values(df, [], cols).where(F.col("value").isNotNull())
    base = lv.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))
    if exact_median:
        med = exact_quantiles(lv, "column", "value", [0.5], ["median"])
    else:
        med = lv.groupBy("column").agg(F.percentile_approx("value", 0.5, 10000).cast("double").alias("median"))
    return base.join(med, "column", "left")


def value_counts(df: DataFrame, column: str, min_count: int | None = None) -> DataFrame:
    """(value, n, share) per category, nulls excluded; optional n > min_count."""
    vc = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = vc.agg(F.sum("n").alias("__tot"))  # one row
    vc = vc.crossJoin(F.broadcast(tot)).withColumn("share", F.col("n") / F.col("__tot")).drop("__tot")
    if min_count is not None:
        vc = vc.where(F.col("n") > min_count)
    return vc


def group_mean_share(df: DataFrame, cat: str, y: str) -> DataFrame:
    """(cat, mean, n, share): mean and count of y per category and the category's share."""
    g = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    tot = df.where(F.col(cat).isNotNull()).agg(F.count(y).alias("tot"))
    return g.crossJoin(F.broadcast(tot)).select(cat, "mean", "n", (F.col("n") / F.col("tot")).alias("share"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tabulation (a, b, n), rows with both present."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix on complete rows as (a, b, r), all pairs in one aggregate."""
    cc = df.select(*cols).na.drop()
    pairs = [(a, b) for a in cols for b in cols]
    one = cc.agg(*[F.corr(a, b).alias(f"{a}|{b}") if a != b else F.lit(1.0).alias(f"{a}|{b}")
                   for a, b in pairs])
    lv = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return lv.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def group_quantiles(df: DataFrame, group: str, y: str, probs=(0.1, 0.25, 0.75, 0.9)) -> DataFrame:
    """Per category: mean, std, min, max and exact percentiles."""
    d = df.where(F.col(group).isNotNull() & F.col(y).isNotNull())
    base = d.groupBy(group).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                                F.min(y).cast("double").alias("min"), F.max(y).cast("double").alias("max"))
    names = [f"p{int(round(p * 100))}" for p in probs]
    q = exact_quantiles(d, group, y, list(probs), names)
    return base.join(q, group, "left")


def quantile_edges(df: DataFrame, x: str, q: int = 3, fallback_equal_width: bool = True) -> DataFrame:
    """One-row table with ``edges`` (array<double>): quantile edges with duplicates dropped;
    when fewer than 3 remain, ``q + 1`` equal-width edges from min to max (D9, S6)."""
    probs = [i / q for i in range(q + 1)]
    names = [f"e{i}" for i in range(q + 1)]
    qs = exact_quantiles(df.where(F.col(x).isNotNull()), [], x, probs, names)
    arr = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in names])))
    out = qs.select(arr.alias("edges"), F.col("e0").alias("lo"), F.col(f"e{q}").alias("hi"))
    if fallback_equal_width:
        eq = F.transform(F.sequence(F.lit(0), F.lit(q)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / q)
        out = out.withColumn("edges", F.when(F.size("edges") < 3, eq).otherwise(F.col("edges")))
    return out.select("edges")


def bin_index(x: Column | str, edges: Column | str) -> Column:
    """Index of the right-closed bin holding x (first bin closed on the left); outside -> null."""
    xc = F.col(x) if isinstance(x, str) else x
    e = F.col(edges) if isinstance(edges, str) else edges
    inner = F.slice(e, 2, F.size(e) - 2)
    idx = F.size(F.filter(inner, lambda v: v < xc))
    inside = (xc >= F.element_at(e, 1)) & (xc <= F.element_at(e, -1))
    return F.when(xc.isNotNull() & inside, idx)


def _fmt_edge(c: Column) -> Column:
    return F.round(c, 2).cast("string")


def bin_label(x: Column | str, edges: Column | str) -> Column:
    """Label "lo to hi" of the bin holding x (edges rounded to 2 decimals)."""
    e = F.col(edges) if isinstance(edges, str) else edges
    i = bin_index(x, e)
    return F.when(i.isNotNull(), F.concat(_fmt_edge(F.element_at(e, i + 1)), F.lit(" to "),
                                          _fmt_edge(F.element_at(e, i + 2))))


def quantile_bins(df: DataFrame, x: str, q: int = 3, out: str = "bin") -> DataFrame:
    """Attach the quantile-bin label of x to every row (D9). The edges table is one row."""
    edges = quantile_edges(df, x, q)
    return df.crossJoin(F.broadcast(edges)).withColumn(out, bin_label(x, "edges")).drop("edges")


def bin_category_share(df: DataFrame, bin_col: str, cat: str) -> DataFrame:
    """(bin, cat, n, share) counts normalised within each bin."""
    c = contingency(df, bin_col, cat)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(bin_col)))


def conditional_share(df: DataFrame, a: str, given: str) -> DataFrame:
    """(given, a, n, share) = P(a | given)."""
    c = contingency(df, given, a)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(given)))


def corr_and_ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: Pearson r, OLS slope and intercept of y on x."""
    return df.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"),
                  F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def cluster_profile(df: DataFrame, cluster: str, var: str) -> DataFrame:
    """(cluster, mean, std) of a variable per cluster, sample std."""
    return df.groupBy(cluster).agg(F.avg(var).alias("mean"), F.stddev_samp(var).alias("std"))


def block_to_codes(df: DataFrame, block: str, code: str) -> DataFrame:
    """(block, codes, n_codes): sorted distinct codes per block, as an array."""
    d = df.where(F.col(block).isNotNull() & F.col(code).isNotNull())
    return d.groupBy(block).agg(F.sort_array(F.collect_set(code)).alias("codes")) \
        .withColumn("n_codes", F.size("codes"))


def distinct_codes(df: DataFrame, code: str) -> DataFrame:
    """Distinct non-null codes as int."""
    return df.where(F.col(code).isNotNull()).select(F.col(code).cast("int").alias(code)).distinct()


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n, mean, std): equal-width bins from min to max; max falls in the last bin."""
    d = df.where(F.col(x).isNotNull())
    st = d.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean"),
               F.stddev_samp(x).alias("std"))
    w = (F.col("mx") - F.col("mn")) / bins
    b = F.least(F.floor((F.col(x) - F.col("mn")) / F.when(w > 0, w).otherwise(F.lit(1.0))).cast("int"),
                F.lit(bins - 1))
    h = d.crossJoin(F.broadcast(st)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.crossJoin(F.broadcast(st)).select(
        "bin", (F.col("mn") + F.col("bin") * w).alias("lo"), (F.col("mn") + (F.col("bin") + 1) * w).alias("hi"),
        "n", "mean", "std")


def describe_continuous(df: DataFrame, x: str) -> DataFrame:
    """One readable line for a continuous column."""
    s = numeric_summary(df, [x])
    return s.select(F.col("column"), F.format_string(
        "%s: mean %.2f, std %.2f, min %.2f, max %.2f, median %.2f",
        F.col("column"), "mean", "std", "min", "max", "median").alias("text"))


def describe_categorical(df: DataFrame, x: str) -> DataFrame:
    """One readable line for a categorical column: values in order with their percent share."""
    vc = value_counts(df, x)
    parts = vc.select(F.struct(F.col("value").cast("string").alias("v"),
                               F.format_string("%s: %.2f%%", F.col("value").cast("string"),
                                               F.col("share") * 100).alias("t")).alias("p"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), ", ")
                     .alias("body")).select(F.lit(x).alias("column"),
                                            F.concat(F.lit(f"{x}: "), F.col("body")).alias("text"))


def token_cost(tokens_in: Column | str, tokens_out: Column | str, price_in: float = 0.01,
               price_out: float = 0.03) -> Column:
    """Cost of calls from token counts, prices per 1,000 tokens."""
    ti = F.col(tokens_in) if isinstance(tokens_in, str) else tokens_in
    to = F.col(tokens_out) if isinstance(tokens_out, str) else tokens_out
    return ti / 1000.0 * price_in + to / 1000.0 * price_out


WS = r"[ \t\r\f\x0B]"
TOKEN = r"[^ \t\r\f\x0B]+"


def word_count(df: DataFrame, text: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Lines with three consecutive ASCII letters, then whitespace words in them.

    Same as ``grep -E '[A-Za-z]{3}' | wc -w``, per group."""
    lines = df.select(*group_cols, F.explode(F.split(F.col(text), "\n")).alias("line"))
    kept = lines.where(F.col("line").rlike("[A-Za-z]{3}"))
    return kept.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.size(F.regexp_extract_all(F.col("line"), F.lit(TOKEN), 0))).cast("bigint").alias("n_words"))


# ---- cluster indices on vector columns (D19, D20, C9) ----

def vector_long(df: DataFrame, key: str, vec: str, label: str | None = None) -> DataFrame:
    """(key, label, pos, v) from an array column."""
    cols = [key] + ([label] if label else [])
    return df.select(*cols, F.posexplode(vec).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def centroids(long: DataFrame, label: str) -> DataFrame:
    return long.groupBy(label, "pos").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))


def centroid_pairs(cent: DataFrame, label: str) -> DataFrame:
    """(i, j, dist) Euclidean distance between every two centroids (C9); k x k rows."""
    a = cent.select(F.col(label).alias("i"), "pos", F.col("c").alias("ci"))
    b = cent.select(F.col(label).alias("j"), "pos", F.col("c").alias("cj"))
    return (a.join(b, "pos").where(F.col("i") != F.col("j"))
             .groupBy("i", "j").agg(F.sqrt(F.sum((F.col("ci") - F.col("cj")) ** 2)).alias("dist")))


def davies_bouldin(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Davies-Bouldin index (D19, S14); k = 1 gives null."""
    lv = vector_long(df, key, vec, label)
    cent = cut_lineage(centroids(lv, label))  # small, and needed several times
    cb = broadcast_checked(cent.select(label, "pos", "c"))
    dist = lv.join(cb, [label, "pos"]).groupBy(key, label).agg(
        F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("d"))
    s = dist.groupBy(label).agg(F.avg("d").alias("s"))
    pairs = centroid_pairs(cent, label)
    si = s.select(F.col(label).alias("i"), F.col("s").alias("si"))
    sj = s.select(F.col(label).alias("j"), F.col("s").alias("sj"))
    r = pairs.join(si, "i").join(sj, "j").withColumn("ratio", (F.col("si") + F.col("sj")) / F.col("dist"))
    per = r.groupBy("i").agg(F.max("ratio").alias("m"))
    return per.agg(F.avg("m").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Calinski-Harabasz index (D20, S14): (B/(k-1)) / (W/(n-k)); k = 1 gives null."""
    lv = vector_long(df, key, vec, label)
    cent = cut_lineage(centroids(lv, label))  # small, and needed several times
    overall = lv.groupBy("pos").agg(F.avg("v").alias("g"))
    cb = broadcast_checked(cent.select(label, "pos", "c"))
    w = lv.join(cb, [label, "pos"]).agg(F.sum((F.col("v") - F.col("c")) ** 2).alias("W"))
    b = cent.join(broadcast_checked(overall), "pos").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) ** 2).alias("B"))
    nk = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"))
    res = w.crossJoin(b).crossJoin(nk)
    return res.select(F.when(F.col("k") > 1, (F.col("B") / (F.col("k") - 1)) / (F.col("W") / (F.col("n") - F.col("k"))))
                      .alias("calinski_harabasz"))
