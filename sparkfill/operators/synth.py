"""Synthetic data and its evaluation (J1-J7, J9-J11; learned tables, J8, are in ``copula.py``).

Generators are column expressions over a key column: every draw is a seeded hash
of (seed, key), so a row's values do not depend on partitioning, and the row set
comes from a table (one synthetic record per key), never from the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.hashing import normal, u
from sparkfill.functions.ordered import exact_quantiles
from sparkfill.session import broadcast_checked, cut_lineage

MAX_CATEGORIES = 10_000   # category shares of the twin are literals: bounded and checked
KS_BINS = 4096            # bins a column in which two samples are first compared

# ---- fixed values of the parametric birth-record generator (must equal the reference) ----
# continuous columns: mean and standard deviation
BIRTH_WEIGHT = (3366.0, 753.0)
GEST_AGE = (39.05, 2.13)
MAT_AGE = (29.30, 5.61)
APGAR_1 = (8.60, 1.93)
APGAR_2 = (9.63, 1.67)
# correlations of the two generated pairs
CORR_WEIGHT_GEST = 0.61
CORR_APGAR = 0.77
# categorical columns: values and probabilities
SMOKING = ([0, 1], [0.8, 0.2])
BREASTFEED = ([0, 1], [0.45, 0.55])
BIRTH_ORDER = ([1, 2], [0.98, 0.02])
SEX = ([0, 1], [0.5, 0.5])
ETHNIC = ([0, 1], [0.64, 0.36])
LABOUR = ([1, 2, 3, 4], [0.60, 0.25, 0.1, 0.05])
PREV_STILLBIRTH = ([0, 1], [0.99, 0.01])
PREV_LIVEBIRTHS = ([0, 1, 2, 3, 4, 5], [0.43, 0.36, 0.13, 0.05, 0.02, 0.01])
REGION_COUNT = 1917                      # uniform code 0..1916
# rounding bounds
WEIGHT_CLIP = (500, 5000)
GEST_CLIP = (25, 50)
APGAR_CLIP = (0, 10)
MAT_AGE_CLIP = (15, 50)
# shifts applied after clipping
SMOKER_WEIGHT_SHIFT = {0: 0, 1: -500}
ORDER_WEIGHT_SHIFT = {1: 0, 2: -1000}
ORDER_GEST_SHIFT = {1: 0, 2: -4}
# breastfeeding at 8 weeks: rate when breastfed at birth, else
BREASTFEED_8WK_RATE = (0.62, 0.10)
# ---- end of fixed values ----


def gen_normal(key, seed: str, mean: float, std: float) -> Column:
    """Normal column."""
    return F.lit(mean) + F.lit(std) * normal(seed, key)


def gen_correlated_pair(key, seed: str, m1: float, s1: float, m2: float, s2: float, r: float) -> tuple[Column, Column]:
    """Two normals with correlation r by the 2x2 Cholesky factor."""
    z1 = normal(f"{seed}.a", key)
    e = normal(f"{seed}.b", key)
    return (F.lit(m1) + F.lit(s1) * z1,
            F.lit(m2) + F.lit(s2) * (F.lit(r) * z1 + F.lit(math.sqrt(1 - r * r)) * e))


def cumulative_thresholds(probs: Sequence[float]) -> list[float]:
    out, acc = [], 0.0
    for p in probs:
        acc += p
        out.append(acc)
    return out


def gen_weighted_category(key, seed: str, values: Sequence, probs: Sequence[float]) -> Column:
    """Draw from values with probabilities."""
    x = u(seed, key)
    cum = cumulative_thresholds(probs)
    expr = None
    for v, c in zip(values[:-1], cum[:-1]):
        expr = F.when(x < c, F.lit(v)) if expr is None else expr.when(x < c, F.lit(v))
    return expr.otherwise(F.lit(values[-1])) if expr is not None else F.lit(values[-1])


def gen_uniform_int(key, seed: str, lo: int, n: int) -> Column:
    """Uniform integer in lo .. lo + n - 1."""
    return (F.floor(u(seed, key) * n) + lo).cast("int")


def clip_round(x: Column, lo: float, hi: float) -> Column:
    """Round half-even, then clip."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.rint(x)))


def shift_by_category(x: Column, by: Column, shifts: Mapping) -> Column:
    """Add an amount that depends on another column."""
    add = F.lit(0.0)
    for k, a in shifts.items():
        if a:
            add = add + F.when(by == F.lit(k), F.lit(float(a))).otherwise(F.lit(0.0))
    return x + add


def gen_conditional_flag(key, seed: str, by: Column, when_value, p_if: float, p_else: float) -> Column:
    """Bernoulli whose rate depends on another column."""
    rate = F.when(by == F.lit(when_value), F.lit(p_if)).otherwise(F.lit(p_else))
    return (u(seed, key) < rate).cast("int")


def generate_table(base: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """The 15-column birth-record generator, one record per key of ``base``."""
    k = F.col(key)
    s = lambda name: f"{seed}:{name}"
    mat_age = gen_normal(k, s("mat_age"), *MAT_AGE)
    a1, a2 = gen_correlated_pair(k, s("apgar"), *APGAR_1, *APGAR_2, CORR_APGAR)
    bw, ga = gen_correlated_pair(k, s("weight_gest"), *BIRTH_WEIGHT, *GEST_AGE, CORR_WEIGHT_GEST)
    d = base.select(
        k.alias(key),
        clip_round(bw, *WEIGHT_CLIP).alias("birth_weight"),
        clip_round(ga, *GEST_CLIP).alias("gest_age"),
        gen_weighted_category(k, s("smoking"), *SMOKING).alias("mat_smoking"),
        gen_weighted_category(k, s("breastfeed"), *BREASTFEED).alias("breastfeed_birth"),
        gen_weighted_category(k, s("birth_order"), *BIRTH_ORDER).alias("birth_order"),
        clip_round(a1, *APGAR_CLIP).alias("apgar_1"),
        clip_round(a2, *APGAR_CLIP).alias("apgar_2"),
        clip_round(mat_age, *MAT_AGE_CLIP).alias("mat_age"),
    )
    d = d.withColumn("birth_weight", shift_by_category(F.col("birth_weight"), F.col("mat_smoking"), SMOKER_WEIGHT_SHIFT))
    d = d.withColumn("birth_weight", shift_by_category(F.col("birth_weight"), F.col("birth_order"), ORDER_WEIGHT_SHIFT))
    d = d.withColumn("gest_age", shift_by_category(F.col("gest_age"), F.col("birth_order"), ORDER_GEST_SHIFT))
    d = d.withColumn("breastfeed_8wks", gen_conditional_flag(k, s("breastfeed_8wks"), F.col("breastfeed_birth"), 1,
                                                             *BREASTFEED_8WK_RATE))
    return d.select(
        "*",
        gen_weighted_category(k, s("ethnic"), *ETHNIC).alias("ethnic_group"),
        gen_weighted_category(k, s("sex"), *SEX).alias("child_sex"),
        gen_weighted_category(k, s("labour"), *LABOUR).alias("labour_onset"),
        gen_weighted_category(k, s("stillbirth"), *PREV_STILLBIRTH).alias("prev_stillbirth"),
        gen_weighted_category(k, s("livebirths"), *PREV_LIVEBIRTHS).alias("prev_livebirths"),
        gen_uniform_int(k, s("region"), 0, REGION_COUNT).alias("mat_region"),
    )


# --------------------------------------------------------------------------- parametric twin

def fit_twin(real: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """Mean/std per numeric column and sorted category shares per categorical column."""
    row = real.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric],
                   *[F.stddev_samp(c).alias(f"s_{c}") for c in numeric]).first() if numeric else None
    params = {"numeric": {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in numeric}, "categorical": {}}
    for c in categorical:
        vc_df = real.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        vc = vc_df.limit(MAX_CATEGORIES + 1).collect()
        if len(vc) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories; treat it as numeric")
        tot = sum(r["n"] for r in vc)
        vals = sorted((r[c], r["n"] / tot) for r in vc)
        params["categorical"][c] = ([v for v, _ in vals], [p for _, p in vals])
    return params


def sample_twin(base: DataFrame, key: str, params: dict, seed: str = "twin") -> DataFrame:
    """One synthetic record per key: independent normals and categorical draws (J1 + J3)."""
    k = F.col(key)
    cols = [gen_normal(k, f"{seed}:{c}", m, s).alias(c) for c, (m, s) in params["numeric"].items()]
    cols += [gen_weighted_category(k, f"{seed}:{c}", v, p).alias(c) for c, (v, p) in params["categorical"].items()]
    return base.select(k.alias(key), *cols)


# --------------------------------------------------------------------------- quality

def validate_table(real: DataFrame, synth: DataFrame, key: str, numeric: Sequence[str],
                   categorical: Sequence[str]) -> DataFrame:
    """(column, metric, score): validity (share of synthetic values inside the real range or
    category set), key uniqueness and shared-column structure (J9, S17)."""
    spark = real.sparkSession
    rows = []
    if numeric:
        rng = real.agg(*[F.min(c).alias(f"mn_{c}") for c in numeric], *[F.max(c).alias(f"mx_{c}") for c in numeric])
        v = synth.crossJoin(F.broadcast(rng)).agg(*[
            F.avg(F.col(c).between(F.col(f"mn_{c}"), F.col(f"mx_{c}")).cast("double")).alias(c) for c in numeric])
        rows.append(v.unpivot([], list(numeric), "column", "score").withColumn("metric", F.lit("validity")))
    for c in categorical:
        cats = real.where(F.col(c).isNotNull()).select(c).distinct().withColumn("__in", F.lit(1.0))
        s = synth.where(F.col(c).isNotNull()).join(broadcast_checked(cats), c, "left")
        rows.append(s.agg(F.avg(F.coalesce(F.col("__in"), F.lit(0.0))).alias("score"))
                    .select(F.lit(c).alias("column"), "score", F.lit("validity").alias("metric")))
    keys = synth.agg((F.countDistinct(key) / F.count(F.lit(1))).alias("score")) \
        .select(F.lit(key).alias("column"), "score", F.lit("key_uniqueness").alias("metric"))
    rows.append(keys)
    shared = len(set(real.columns) & set(synth.columns)) / len(set(real.columns) | set(synth.columns))
    rows.append(spark.createDataFrame([("*", float(shared), "structure")], "column string, score double, metric string"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("column", "metric", "score")


def ks_score(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, metric='ks_complement', score = 1 - sup|F_real - F_synth|).

    One aggregate counts both samples in ``KS_BINS`` bins of equal width a column. The running counts give the
    gap at the last value of each bin, and a bound of the gap at any value inside. Only the
    values of bins whose bound exceeds the largest gap found so are looked at one by one (bucketed prefix sums),
    so the supremum is exact."""
    from sparkfill.functions.scalars import long_values
    from sparkfill.operators.distance import asof_prefix
    spark, cols = real.sparkSession, list(cols)
    ends = []
    for df in (real, synth):
        x = {c: F.col(c).cast("double") for c in cols}
        finite = {c: F.when(F.abs(x[c]) < float("inf"), x[c]) for c in cols}
        ends.append(df.agg(*[f(finite[c]).alias(f"{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))]).first())
    limits = []
    for c in cols:
        lo, hi = (f([e[f"{p}_{c}"] for e in ends if e[f"{p}_{c}"] is not None], default=0.0) for p, f in (("lo", min), ("hi", max)))
        limits.append((c, lo, hi - lo if math.isfinite(hi - lo) else 0.0))
    limits = F.broadcast(spark.createDataFrame(limits, "column string, lo double, width double"))  # a row a column
    v = F.col("value")
    at = F.when(F.col("width") > 0, F.least(F.lit(KS_BINS - 1), F.floor((v - F.col("lo")) / F.col("width") * KS_BINS))).otherwise(F.lit(0))
    place = F.when(F.isnan(v), KS_BINS + 1).when(v == float("inf"), KS_BINS).when(v == float("-inf"), -1).otherwise(at).cast("int")
    r = long_values(real, [], cols).select("*", F.lit(1).cast("bigint").alias("cr"), F.lit(0).cast("bigint").alias("cs"))
    s = long_values(synth, [], cols).select("*", F.lit(0).cast("bigint").alias("cr"), F.lit(1).cast("bigint").alias("cs"))
    rows = r.unionByName(s).where(v.isNotNull()).join(limits, "column").select("column", place.alias("bin"), "value", "cr", "cs")
    counted = rows.groupBy("column", "bin").agg(F.sum("cr").alias("cr"), F.sum("cs").alias("cs")).collect()  # KS_BINS + 3 a column at most
    best, still = {}, []
    for c in cols:
        bins = sorted((b.bin, b.cr, b.cs) for b in counted if b["column"] == c)
        nr, ns = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not bins:
            continue
        best[c] = None
        if nr and ns:
            cr = cs = 0
            bounds = []
            best[c] = 0.0
            for at_bin, more_r, more_s in bins:
                bounds.append((at_bin, cr, cs, max(abs((cr + more_r) / nr - cs / ns), abs(cr / nr - (cs + more_s) / ns))))
                cr, cs = cr + more_r, cs + more_s
                best[c] = max(best[c], abs(cr / nr - cs / ns))
            still += [(c, at_bin, br, bs, nr, ns) for at_bin, br, bs, bound in bounds if bound > best[c]]
    if still:
        some = F.broadcast(spark.createDataFrame(still, "column string, bin int, br long, bs long, nr long, ns long"))  # of those counted
        pts = rows.join(some.select("column", "bin"), ["column", "bin"]).groupBy("column", "bin", "value").agg(F.sum("cr").alias("cr"), F.sum("cs").alias("cs"))
        pts = cut_lineage(pts)
        cum = asof_prefix(pts, pts.select("column", "bin", "value"), ["column", "bin"], "value", ["cr", "cs"]).join(some, ["column", "bin"])
        gap = F.abs((F.col("br") + F.col("cum_cr")) / F.col("nr") - (F.col("bs") + F.col("cum_cs")) / F.col("ns"))
        for g in cum.groupBy("column").agg(F.max(gap).alias("gap")).collect():
            best[g["column"]] = max(best[g["column"]], g.gap)
    return spark.createDataFrame([(c, "ks_complement", None if g is None else 1 - g) for c, g in best.items()], "column string, metric string, score double")


def tv_score(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, metric='tv_complement', score = 1 - 0.5 sum|p_real - p_synth|)."""
    from sparkfill.functions.scalars import long_values
    def shares(df, name):
        lv = long_values(df, [], cols, cast="string").where(F.col("value").isNotNull())
        c = cut_lineage(lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        t = c.groupBy("column").agg(F.sum("n").alias("t"))
        return c.join(broadcast_checked(t), "column").select("column", "value", (F.col("n") / F.col("t")).alias(name))
    j = shares(real, "pr").join(shares(synth, "ps"), ["column", "value"], "full").fillna(0.0, ["pr", "ps"])
    return j.groupBy("column").agg((1 - 0.5 * F.sum(F.abs(F.col("pr") - F.col("ps")))).alias("score")) \
        .withColumn("metric", F.lit("tv_complement")).select("column", "metric", "score")


def column_shape_score(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                       categorical: Sequence[str]) -> DataFrame:
    parts = []
    if numeric:
        parts.append(ks_score(real, synth, numeric))
    if categorical:
        parts.append(tv_score(real, synth, categorical))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _contingency_similarity(real: DataFrame, synth: DataFrame, a: str, b: str, names: tuple[str, str], metric: str) -> DataFrame:
    """1 - 0.5 sum|p_real - p_synth| over the pairs of values of two columns of counted (``n``) tables."""
    def shares(df, name):
        d = df.select(F.col(a).alias("va"), F.col(b).alias("vb"), "n").where(F.col("va").isNotNull() & F.col("vb").isNotNull())
        c = d.groupBy("va", "vb").agg(F.sum("n").alias("n"))
        t = c.agg(F.sum("n").alias("t"))
        return c.crossJoin(F.broadcast(t)).select("va", "vb", (F.col("n") / F.col("t")).alias(name))  # with one row
    j = shares(real, "pr").join(shares(synth, "ps"), ["va", "vb"], "full").fillna(0.0, ["pr", "ps"])
    return j.agg((1 - 0.5 * F.sum(F.abs(F.col("pr") - F.col("ps")))).alias("score")).select(
        F.lit(names[0]).alias("a"), F.lit(names[1]).alias("b"), F.lit(metric).alias("metric"), "score")


def pair_trend_score(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                     categorical: Sequence[str], bins: int = 10) -> DataFrame:
    """(a, b, metric, score) of every column pair (J11): correlation similarity 1 - |r_r - r_s| / 2 for numeric
    pairs, contingency similarity 1 - 0.5 sum|p_r - p_s| for categorical pairs, and the same for mixed ones, the
    number cut at the real table's quantiles (``bins``) in both tables. Each table is counted once
    by all of these columns together, and every pair of them is counted from that."""
    spark = real.sparkSession
    out = None
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    if pairs:
        rr = real.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
        ss = synth.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
        rows = [(a, b, "correlation_similarity",
                 None if rr[f"{a}|{b}"] is None or ss[f"{a}|{b}"] is None
                 else 1 - abs(rr[f"{a}|{b}"] - ss[f"{a}|{b}"]) / 2) for a, b in pairs]
        out = spark.createDataFrame(rows, "a string, b string, metric string, score double")
    values = {f"c{i}": F.col(b).cast("string") for i, b in enumerate(categorical)}
    parts = [(f"c{i}", f"c{j}", (a, categorical[j]), "contingency_similarity") for i, a in enumerate(categorical) for j in range(i + 1, len(categorical))]
    if categorical:
        for k, a in enumerate(numeric):
            cuts = exact_quantiles(real.where(F.col(a).isNotNull()), None, a, [i / bins for i in range(1, bins)]).first()
            place = F.when(F.col(a).isNotNull(), sum((F.when(F.col(a).cast("double") > c, 1).otherwise(0) for c in cuts if c is not None), F.lit(0)))
            values[f"n{k}"] = place
            parts += [(f"n{k}", f"c{i}", (a, b), "binned_contingency_similarity") for i, b in enumerate(categorical)]
    if parts:
        real, synth = (cut_lineage(df.select(*[v.alias(n) for n, v in values.items()]).groupBy(*values).agg(F.count(F.lit(1)).alias("n"))) for df in (real, synth))
    for part in parts:
        r = _contingency_similarity(real, synth, *part)
        out = r if out is None else out.unionByName(r)
    return out
