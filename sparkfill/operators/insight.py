"""Statistical insights per record (K1-K3, K6, K7).

Each (inductor A, target B) analysis is computed once for the table (or once per
cluster) as a small table keyed by A's value or A's bin; records only join it.
Four analyses, chosen by the types of A and B:

* A numeric, B numeric: correlation and the straight-line prediction of B at A;
* A categorical, B categorical: shares of B's categories given A's value;
* A numeric, B categorical: A's summary per B category, and B's shares in A's tertile bin;
* A categorical, B numeric: share of A's value inside each tertile bin of B.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import exact_quantiles
from sparkfill.functions.template import Template, lit, num, raw, val
from sparkfill.operators.profile import bin_index, bin_label
from sparkfill.session import broadcast_checked

PCTS = (0.1, 0.25, 0.75, 0.9)


def _g(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn("__g", F.lit(0)), ["__g"]


def _ordered_join(key_col, text_col, sep: str):
    """Aggregate: texts joined in key order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("k"),
                                                                           F.col(text_col).alias("t")))),
                                    lambda x: x["t"]), sep)


# ---- templates (shared with the SQL oracle through column names) ----

def tpl_numeric_pair(a: str, b: str) -> Template:
    return Template(lit(f"{b} and {a} correlate at "), num("r"),
                    lit(f"; a straight-line fit gives {b} = "), num("pred"), lit(f" at {a} = "), num(a), lit("."))


def tpl_category_pair(a: str, b: str) -> Template:
    return Template(lit(f"When {a} = "), val(a), lit(f", {b} is "), raw("dist_text", "dist_text"), lit("."))


def tpl_numeric_by_category(a: str, b: str) -> Template:
    return Template(lit(f"{a} by {b}: "), raw("stats_text", "stats_text"),
                    lit(f". In the {a} bin "), raw("bin", "bin"), lit(f", {b} is "),
                    raw("bin_text", "bin_text"), lit("."))


def tpl_category_by_bins(a: str, b: str) -> Template:
    return Template(lit(f"Share of {a} = "), val(a), lit(f" in each {b} bin: "),
                    raw("share_text", "share_text"), lit("."))


def stat_item_template(cat_col: str = "cat") -> Template:
    return Template(val(cat_col), lit(": mean "), num("mean"), lit(", sd "), num("std"), lit(", min "), num("mn"),
                    lit(", max "), num("mx"), lit(", p10 "), num("p10"), lit(", p25 "), num("p25"),
                    lit(", p75 "), num("p75"), lit(", p90 "), num("p90"))


def share_item_template(cat_col: str = "cat") -> Template:
    return Template(val(cat_col), lit(": "), num("p"))


# ---- the four analyses ----

def numeric_pair(data: DataFrame, records: DataFrame, key: str, a: str, b: str,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    d, g = _g(data.where(F.col(a).isNotNull() & F.col(b).isNotNull()), group_cols)
    st = d.groupBy(*g).agg(F.corr(a, b).alias("r"), F.regr_slope(b, a).alias("slope"),
                           F.regr_intercept(b, a).alias("icpt"))
    r, _ = _g(records.where(F.col(a).isNotNull()).select(key, *group_cols, a), group_cols)
    j = r.join(broadcast_checked(st), g).withColumn("pred", F.col("icpt") + F.col("slope") * F.col(a))
    return j.select(key, tpl_numeric_pair(a, b).spark().alias("insight"))


def category_pair(data: DataFrame, records: DataFrame, key: str, a: str, b: str,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    d, g = _g(data.where(F.col(a).isNotNull() & F.col(b).isNotNull()), group_cols)
    c = d.groupBy(*g, a, F.col(b).alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*g, a).agg(F.sum("n").alias("t"))
    sh = c.join(t, g + [a]).withColumn("p", F.col("n") / F.col("t")) \
        .withColumn("txt", share_item_template().spark())
    dist = sh.groupBy(*g, a).agg(_ordered_join("cat", "txt", ", ").alias("dist_text"))
    r, _ = _g(records.where(F.col(a).isNotNull()).select(key, *group_cols, a), group_cols)
    j = r.join(broadcast_checked(dist), g + [a], "left")
    return j.select(key, tpl_category_pair(a, b).spark().alias("insight"))


def _edges(d: DataFrame, g: list[str], x: str, fallback: bool) -> DataFrame:
    names = ["e0", "e1", "e2", "e3"]
    q = exact_quantiles(d, g, x, [0.0, 1 / 3, 2 / 3, 1.0], names)
    e = q.select(*g, F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in names]))).alias("edges"),
                 F.col("e0").alias("lo"), F.col("e3").alias("hi"))
    if fallback:
        eq = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / 3)
        e = e.withColumn("edges", F.when(F.size("edges") < 3, eq).otherwise(F.col("edges")))
    return e.select(*g, "edges")


def numeric_by_category(data: DataFrame, records: DataFrame, key: str, a: str, b: str,
                        group_cols: Sequence[str] = ()) -> DataFrame:
    d, g = _g(data.where(F.col(a).isNotNull() & F.col(b).isNotNull()), group_cols)
    d = d.withColumn("cat", F.col(b))
    base = d.groupBy(*g, "cat").agg(F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"),
                                    F.min(a).cast("double").alias("mn"), F.max(a).cast("double").alias("mx"))
    q = exact_quantiles(d, g + ["cat"], a, list(PCTS), ["p10", "p25", "p75", "p90"])
    st = base.join(q, g + ["cat"]).withColumn("txt", stat_item_template().spark())
    stats = st.groupBy(*g).agg(_ordered_join("cat", "txt", "; ").alias("stats_text"))
    edges = broadcast_checked(_edges(d, g, a, fallback=True))
    db = d.join(edges, g).withColumn("bi", bin_index(a, "edges")).withColumn("bin", bin_label(a, "edges"))
    c = db.where(F.col("bi").isNotNull()).groupBy(*g, "bi", "bin", "cat").agg(F.count(F.lit(1)).alias("n"))
    tb = c.groupBy(*g, "bi").agg(F.sum("n").alias("t"))
    sh = c.join(tb, g + ["bi"]).withColumn("p", F.col("n") / F.col("t")).withColumn("txt", share_item_template().spark())
    bins = sh.groupBy(*g, "bi", "bin").agg(_ordered_join("cat", "txt", ", ").alias("bin_text"))
    r, _ = _g(records.where(F.col(a).isNotNull()).select(key, *group_cols, a), group_cols)
    r = r.join(edges, g).withColumn("bi", bin_index(a, "edges")).drop("edges")
    j = r.join(broadcast_checked(bins), g + ["bi"], "left").join(broadcast_checked(stats), g, "left")
    return j.select(key, tpl_numeric_by_category(a, b).spark().alias("insight"))


def category_by_bins(data: DataFrame, records: DataFrame, key: str, a: str, b: str,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    d, g = _g(data.where(F.col(a).isNotNull() & F.col(b).isNotNull()), group_cols)
    edges = broadcast_checked(_edges(d, g, b, fallback=False))
    db = d.join(edges, g).withColumn("bi", bin_index(b, "edges")).withColumn("bin", bin_label(b, "edges"))
    db = db.where(F.col("bi").isNotNull())
    labels = db.groupBy(*g, "bi").agg(F.first("bin").alias("bin"), F.count(F.lit(1)).alias("t"))
    c = db.groupBy(*g, "bi", a).agg(F.count(F.lit(1)).alias("n"))
    cats = d.select(*g, a).distinct()
    # every (value of A, bin) pair: categories x at most three bins, pivoted, missing -> 0
    pv = c.groupBy(*g, a).pivot("bi", [0, 1, 2]).agg(F.first("n"))
    full = cats.join(pv, g + [a], "left").unpivot(g + [a], ["0", "1", "2"], "bi", "n") \
        .withColumn("bi", F.col("bi").cast("int")).fillna(0, ["n"])
    sh = full.join(labels, g + ["bi"]).withColumn("p", F.col("n") / F.col("t"))
    sh = sh.withColumn("txt", Template(raw("bin", "bin"), lit(": "), num("p")).spark())
    share = sh.groupBy(*g, a).agg(_ordered_join("bi", "txt", ", ").alias("share_text"))
    r, _ = _g(records.where(F.col(a).isNotNull()).select(key, *group_cols, a), group_cols)
    j = r.join(broadcast_checked(share), g + [a], "left")
    return j.select(key, tpl_category_by_bins(a, b).spark().alias("insight"))


def pair_insight(data: DataFrame, records: DataFrame, key: str, a: str, b: str, continuous: set[str],
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """(key, insight) for inductor ``a`` and target ``b`` (K2)."""
    ca, cb = a in continuous, b in continuous
    if ca and cb:
        return numeric_pair(data, records, key, a, b, group_cols)
    if not ca and not cb:
        return category_pair(data, records, key, a, b, group_cols)
    if ca:
        return numeric_by_category(data, records, key, a, b, group_cols)
    return category_by_bins(data, records, key, a, b, group_cols)


def record_insights(data: DataFrame, records: DataFrame, key: str, target: str, variables: Sequence[str],
                    continuous: set[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(key, n_insights, insights): the record's non-null variables, in the given order,
    joined by newlines (K3). Records whose every variable is null get no row."""
    parts = None
    for i, v in enumerate(variables):
        p = pair_insight(data, records, key, v, target, continuous, group_cols).withColumn("__i", F.lit(i))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("n_insights"),
                                  _ordered_join("__i", "insight", "\n").alias("insights"))


def variable_dictionary(df: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """(column, description, missing_pct) for the columns of ``df`` (K1)."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(c, descriptions.get(c)) for c in df.columns], "column string, description string")
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    miss = one.unpivot([], df.columns, "column", "missing_pct")
    return dim.join(miss, "column")


def minority_vote(cols: Sequence[str]) -> tuple:
    """For three 0/1 strategy columns: (votes, majority, minority); minority null when unanimous (K6)."""
    s = sum((F.col(c).cast("int") for c in cols), F.lit(0))
    majority = F.when(s >= 2, F.lit(1)).otherwise(F.lit(0))
    minority = F.when(s == 1, F.lit(1)).when(s == 2, F.lit(0))
    return s, majority, minority


def indicator_rule(indicators: Sequence, threshold: int = 2) -> tuple:
    """(count of true indicators, decision = count >= threshold) (K7); null indicators count false."""
    n = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in indicators), F.lit(0))
    return n, (n >= threshold).cast("int")
