"""Queries: simple fills, masking, scoring, strategies (I*, D16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import score
from sparkfill.operators.impute import simple
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec

TARGETS = ["area", "flag", "weight"]


def _fill_query(method):
    def run(spark, sf):
        rec = records(spark, sf)
        filled = simple.impute_constant(missing_view(rec), TARGETS, method)
        return round_doubles(filled.select("row_id", *TARGETS))
    return run


_FILL_SQL = {
    "impute_nop": "SELECT row_id, area, flag, weight FROM rec",
    "impute_mean": """SELECT row_id, round(coalesce(cast(area AS double), s.a), 6) AS area,
        round(coalesce(cast(flag AS double), s.f), 6) AS flag, round(coalesce(weight, s.w), 6) AS weight
        FROM rec, (SELECT avg(area) a, avg(flag) f, avg(weight) w FROM rec) s""",
    "impute_median": """SELECT row_id, round(coalesce(cast(area AS double), s.a), 6) AS area,
        round(coalesce(cast(flag AS double), s.f), 6) AS flag, round(coalesce(weight, s.w), 6) AS weight
        FROM rec, (SELECT quantile_cont(area, 0.5) a, quantile_cont(flag, 0.5) f,
                          quantile_cont(weight, 0.5) w FROM rec) s""",
    "impute_most_frequent": """SELECT row_id, coalesce(area, s.a) AS area, coalesce(flag, s.f) AS flag,
        round(coalesce(weight, s.w), 6) AS weight
        FROM rec, (SELECT (SELECT area FROM rec WHERE area IS NOT NULL GROUP BY area ORDER BY count(*) DESC, area LIMIT 1) a,
                          (SELECT flag FROM rec WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) f,
                          (SELECT weight FROM rec WHERE weight IS NOT NULL GROUP BY weight ORDER BY count(*) DESC, weight LIMIT 1) w) s""",
}

for _k, _sql in _FILL_SQL.items():
    query(_k, with_rec(_sql))(_fill_query(_k.replace("impute_", "")))


@query("score_mae", with_rec("""
SELECT strategy, 'weight' AS target, round(avg(abs(p - true_weight)), 6) AS mae, count(*) AS n FROM (
  SELECT 'mean' AS strategy, s.m AS p, true_weight FROM rec, s WHERE weight IS NULL
  UNION ALL SELECT 'median', s.med, true_weight FROM rec, s WHERE weight IS NULL
  UNION ALL SELECT 'ols_qty', s.a + s.b * qty, true_weight FROM rec, s WHERE weight IS NULL
) x GROUP BY strategy""", """s AS (SELECT avg(weight) m, quantile_cont(weight, 0.5) med,
      regr_slope(weight, qty) b, regr_intercept(weight, qty) a FROM rec)"""))
def q_score_mae(spark, sf):
    """Minimum slice: how wrong is each simple fill on the hidden weights?"""
    rec = records(spark, sf)
    obs = missing_view(rec)
    mean = simple.fill_values(obs, ["weight"], "mean")["weight"]
    med = simple.fill_values(obs, ["weight"], "median")["weight"]
    line = obs.agg(F.regr_slope("weight", "qty").alias("b"), F.regr_intercept("weight", "qty").alias("a")).first()
    hidden = rec.where(F.col("weight").isNull()).select(
        "true_weight",
        F.lit(mean).alias("mean"), F.lit(med).alias("median"),
        (F.lit(line["a"]) + F.lit(line["b"]) * F.col("qty")).alias("ols_qty"))
    out = score.score_mae(hidden, "true_weight", ["mean", "median", "ols_qty"], "weight")
    return round_doubles(out)


# ---------------------------------------------------------------- registry, table, strategies

from sparkfill.functions.hashing import sql_order_key  # noqa: E402
from sparkfill.operators import sampling  # noqa: E402
from sparkfill.operators.impute import registry, strategies  # noqa: E402
from sparkfill.plans.records import truth_view  # noqa: E402

KF = ["acct", "n_items", "qty", "price", "site"]


@query("imputer_registry", with_rec("""
SELECT 'nop' AS method, count(*) - count(area) + count(*) - count(flag) + count(*) - count(weight) AS nulls_after FROM rec
UNION ALL SELECT 'mean', 0 FROM rec GROUP BY ALL HAVING count(*) > 0
UNION ALL SELECT 'median', 0 FROM rec GROUP BY ALL HAVING count(*) > 0
UNION ALL SELECT 'most_frequent', 0 FROM rec GROUP BY ALL HAVING count(*) > 0"""))
def q_imputer_registry(spark, sf):
    obs = missing_view(records(spark, sf)).select("row_id", *TARGETS)
    out = None
    for m in ("nop", "mean", "median", "most_frequent"):
        f = registry.impute_table(obs, TARGETS, m)
        row = f.agg(sum((F.count(F.lit(1)) - F.count(c) for c in TARGETS), F.lit(0)).alias("nulls_after")) \
            .select(F.lit(m).alias("method"), "nulls_after")
        out = row if out is None else out.unionByName(row)
    return out


_TBL = ["acct", "n_items", "qty", "price", "site", "area", "flag", "weight"]


@query("impute_table", with_rec("SELECT row_id, " + ", ".join(
    f"round(coalesce(cast(rec.{c} AS double), s.{c}), 6) AS {c}" for c in _TBL)
    + " FROM rec, (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _TBL) + " FROM rec) s"))
def q_impute_table(spark, sf):
    obs = missing_view(records(spark, sf)).select("row_id", *_TBL)
    return round_doubles(registry.impute_table(obs, _TBL, "mean"))


def _knn_sql_parts(cluster_expr, feats, min_size=150):
    return [
        f"rc AS (SELECT *, {cluster_expr} AS cl FROM rec)",
        "sz AS (SELECT cl, count(*) AS n FROM rc GROUP BY cl)",
        f"""pp AS (SELECT r.row_id, d.row_id AS donor, d.weight,
   sqrt(({' + '.join(f'(r.{c} - d.{c}) * (r.{c} - d.{c})' for c in feats)}) * ({len(feats)} / {len(feats)})) AS dist
   FROM rc r JOIN sz USING (cl) JOIN rc d ON d.cl = r.cl AND d.weight IS NOT NULL
   WHERE r.weight IS NULL AND sz.n <= {min_size})""",
        """kf AS (SELECT row_id, avg(weight) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, donor) rn
   FROM pp) WHERE rn <= 5 GROUP BY row_id)""",
        "cm AS (SELECT cl, avg(weight) AS m FROM rc GROUP BY cl)",
    ]


@query("impute_by_cluster", with_rec("""SELECT r.row_id, round(CASE WHEN r.weight IS NOT NULL THEN r.weight
    WHEN sz.n > 150 THEN cm.m ELSE coalesce(kf.fill, (SELECT avg(weight) FROM rec)) END, 6) AS weight
  FROM rc r JOIN sz USING (cl) JOIN cm USING (cl) LEFT JOIN kf USING (row_id)""",
    *_knn_sql_parts("concat_ws('|', district, seg)", KF)))
def q_impute_by_cluster(spark, sf):
    obs = missing_view(records(spark, sf)).withColumn("cl", F.concat_ws("|", "district", "seg"))
    out = strategies.impute_by_cluster(obs.select("row_id", "cl", "weight", *KF), "row_id", "cl", "weight", KF, "mean")
    return round_doubles(out.select("row_id", "weight"))


def _prefill_sql():
    hide = f"""hid AS (SELECT row_id FROM rec WHERE weight IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY {sql_order_key('sparse', 'row_id')}, row_id)
   <= (SELECT floor(0.95::DOUBLE * count(weight)) FROM rec))"""
    mk = "mk AS (SELECT row_id, district, CASE WHEN row_id IN (SELECT row_id FROM hid) THEN NULL ELSE weight END AS weight FROM rec)"
    cur = "cur AS (SELECT (avg(weight) + quantile_cont(weight, 0.5)) / 2 AS pre FROM mk)"
    st = "st AS (SELECT district, count(*) AS n, count(*) - count(weight) AS nm FROM mk GROUP BY district)"
    q = "qu AS (SELECT district, nm - floor(n * 0.9) AS quota FROM st WHERE nm > 0.9 * n)"
    ch = f"""ch AS (SELECT mk.row_id FROM mk JOIN qu USING (district) WHERE mk.weight IS NULL
  QUALIFY row_number() OVER (PARTITION BY district ORDER BY {sql_order_key('prefill', 'mk.row_id')}, mk.row_id) <= quota)"""
    return with_rec("""SELECT row_id, round(coalesce(weight, CASE WHEN row_id IN (SELECT row_id FROM ch) THEN cur.pre END), 6) AS weight
  FROM mk, cur""", hide, mk, cur, st, q, ch)


@query("prefill_sparse_cluster", _prefill_sql())
def q_prefill_sparse_cluster(spark, sf):
    obs = missing_view(records(spark, sf)).select("row_id", "district", "weight")
    masked, _ = sampling.mask_random(obs, "weight", "sparse", rate=0.95)
    mean = simple.impute_constant(masked.select("row_id", "weight"), ["weight"], "mean").withColumnRenamed("weight", "s_mean")
    med = simple.impute_constant(masked.select("row_id", "weight"), ["weight"], "median").withColumnRenamed("weight", "s_med")
    current = mean.join(med, "row_id")
    out = strategies.prefill_sparse_cluster(masked, "row_id", "district", "weight", current, ["s_mean", "s_med"])
    return round_doubles(out.select("row_id", "weight"))


def ols_sql(rows, y, xs, group=None):
    """DuckDB least squares of ``y`` on one or two columns over ``rows`` (a table), by ``group``: b0, b1 (, b2)."""
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    if len(xs) == 1:
        return f"(SELECT {g}regr_intercept({y}, {xs[0]}) AS b0, regr_slope({y}, {xs[0]}) AS b1 FROM {rows} {by})"
    a, b = xs
    d = "(saa * sbb - sab * sab)"
    b1, b2 = f"((say * sbb - sby * sab) / {d})", f"((sby * saa - say * sab) / {d})"
    return f"""(SELECT {g}my - {b1} * ma - {b2} * mb AS b0, {b1} AS b1, {b2} AS b2 FROM (SELECT {g}avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb,
    covar_pop({a}, {a}) AS saa, covar_pop({b}, {b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby
    FROM {rows} {by}))"""


def _clip(e, lo, hi):
    return f"greatest({lo}, least({hi}, {e}))"


_TWO = ["qty", "price"]


@query("impute_three_ways", with_rec(f"""SELECT rec.row_id,
  round(coalesce(weight, {_clip('f.b0 + f.b1 * qty + f.b2 * price', 'r.lo', 'r.hi')}), 6) AS weight_imputed_full,
  round(coalesce(weight, {_clip('s.b0 + s.b1 * qty', 'r.lo', 'r.hi')}), 6) AS weight_imputed_full_selected,
  round(coalesce(weight, {_clip('c.b0 + c.b1 * qty', 'cr.lo', 'cr.hi')}), 6) AS weight_imputed_cluster
  FROM rec JOIN {ols_sql('known', 'weight', ['qty'], 'district')} c USING (district)
  JOIN (SELECT district, min(weight) AS lo, max(weight) AS hi FROM known GROUP BY district) cr USING (district),
  {ols_sql('known', 'weight', _TWO)} f, {ols_sql('known', 'weight', ['qty'])} s, (SELECT min(weight) AS lo, max(weight) AS hi FROM known) r""",
    "known AS (SELECT * FROM rec WHERE weight IS NOT NULL)"))
def q_impute_three_ways(spark, sf):
    """Least squares on both features, on the selected one, and on it inside each district."""
    obs = missing_view(records(spark, sf))
    labels = obs.select("row_id", F.col("district").alias("cluster"))
    out = strategies.impute_three_ways(obs.select("row_id", "weight", *_TWO), "row_id", "weight", _TWO, labels, selected=["qty"], method="ice")
    return round_doubles(out)


def _strat_sql(targets, categorical):
    parts = []
    for t in targets:
        rnd = (lambda e: f"round_even({e}, 0)") if t in categorical else (lambda e: e)
        full = rnd(f"coalesce(cast(rec.{t} AS double), g.m)")
        clus = rnd(f"coalesce(cast(rec.{t} AS double), c.m)")
        comb_inner = f"({full} + {full} + {clus}) / 3"
        comb = rnd(comb_inner)
        parts.append(f"""SELECT '{t}' AS target, row_id, round({full}, 6) AS imputed_full,
  round({full}, 6) AS imputed_full_selected, round({clus}, 6) AS imputed_cluster,
  round(cast(true_{t} AS double), 6) AS truth, round({comb}, 6) AS combined
  FROM rec JOIN (SELECT district, avg({t}) AS m FROM rec GROUP BY district) c USING (district),
  (SELECT avg({t}) AS m FROM rec) g""")
    return with_rec("\nUNION ALL ".join(parts))


def _strategies(spark, sf, targets, categorical):
    rec = records(spark, sf)
    obs = missing_view(rec)
    labels = obs.select("row_id", F.col("district").alias("cluster"))
    out = strategies.strategies_for_targets(obs, truth_view(rec), "row_id", targets, KF, labels,
                                            categorical=categorical, method="mean")
    return round_doubles(out)


@query("impute_strategies_only", _strat_sql(["weight", "flag", "area"], ["flag", "area"]))
def q_impute_strategies_only(spark, sf):
    return _strategies(spark, sf, ["weight", "flag", "area"], ["flag", "area"])


@query("impute_one_target", _strat_sql(["area"], ["area"]))
def q_impute_one_target(spark, sf):
    return _strategies(spark, sf, ["area"], ["area"])


#: (selection, clustering) of the benchmark query: every setting changes the answer.
BENCH = [(("qty",), None), (("price",), None), (("qty", "price"), None), (("qty",), "district"), (("price",), "district")]


def _bench_sql():
    parts, ctes = [], []
    for seed in (0, 1):
        ctes.append(f"""h{seed} AS (SELECT row_id FROM rec WHERE weight IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY {sql_order_key(f'sim{seed}', 'row_id')}, row_id)
   <= (SELECT floor(greatest(0.1, avg((weight IS NULL)::int)) * count(weight)) FROM rec))""")
        ctes.append(f"""mk{seed} AS (SELECT row_id, district, qty, price, CASE WHEN row_id IN (SELECT row_id FROM h{seed}) THEN NULL ELSE weight END AS w,
  weight AS orig, row_id IN (SELECT row_id FROM h{seed}) AS hidden FROM rec)""")
        ctes.append(f"kn{seed} AS (SELECT * FROM mk{seed} WHERE w IS NOT NULL)")
        for xs, group in BENCH:
            on = f"USING ({group})" if group else "ON true"
            g = f"{group}, " if group else ""
            by = f"GROUP BY {group}" if group else ""
            ols = _clip(" + ".join(["b0", *(f"b{i + 1} * {x}" for i, x in enumerate(xs))]), "lo", "hi")
            for method, e in (("mean", "m"), ("ice", ols)):
                parts.append(f"""SELECT '{method}' AS method, '{'+'.join(xs)}' AS selection, '{group or 'none'}' AS clustering, false AS mnar,
  {seed} AS seed, 'weight' AS target, {len(xs)} AS n_selected, {"(SELECT count(DISTINCT district)::INT FROM rec)" if group else 1} AS n_clusters,
  round(avg(abs({e} - orig)), 6) AS mae, count(*) AS n
  FROM mk{seed} JOIN {ols_sql(f'kn{seed}', 'w', list(xs), group)} o {on}
  JOIN (SELECT {g}min(w) AS lo, max(w) AS hi, avg(w) AS m FROM kn{seed} {by}) r {on} WHERE hidden""")
    return with_rec("\nUNION ALL ".join(parts), *ctes)


@query("benchmark_imputers", _bench_sql())
def q_benchmark_imputers(spark, sf):
    obs = missing_view(records(spark, sf)).select("row_id", "weight", "district", *_TWO)
    out = strategies.benchmark_imputers(obs, "row_id", "weight", ["mean", "ice"], [(s, c, False) for s, c in BENCH], [0, 1], _TWO)
    return round_doubles(out)


@query("benchmark_subpopulations")
def q_benchmark_subpopulations(spark, sf):
    """Features selected by the elastic net, clusters formed on the rest, with and without indicators of missing cells."""
    obs = missing_view(records(spark, sf)).select("row_id", "weight", "flag", *KF)
    out = strategies.benchmark_imputers(obs, "row_id", "weight", ["ice"], [("LASSO", "reduced", False), ("LASSO", "reduced", True), (None, None, True)],
                                        [0], [*KF, "flag"])
    return round_doubles(out)


@query("prepare_records", with_rec("""SELECT row_id, district, area, dep_score, n_items, qty, price_k, site, flag, weight,
  d_seg.code AS seg, d_prio.code AS prio FROM (
  SELECT row_id, district, area, n_regionkey AS dep_score, n_items, qty, price * 0.001 AS price_k, site, flag, weight,
    seg, CASE WHEN lower(prio) IN ('5-low') THEN NULL ELSE prio END AS prio
  FROM rec LEFT JOIN (SELECT n_nationkey AS area, n_regionkey FROM nation) lk USING (area)
  WHERE row_id IN (SELECT row_id FROM rec WHERE CASE WHEN lower(seg) IN ('household') THEN NULL ELSE seg END IS NOT NULL)) r
  LEFT JOIN d_seg ON r.seg = d_seg.v LEFT JOIN d_prio ON r.prio = d_prio.v""",
    """c_seg AS (SELECT seg AS v, count(*) AS n FROM (SELECT seg FROM rec WHERE row_id IN (SELECT row_id FROM rec WHERE lower(seg) <> 'household')) GROUP BY seg),
f_seg AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM c_seg WHERE n >= 80),
d_seg AS (SELECT v, code FROM f_seg UNION ALL SELECT v, (SELECT CAST(count(*) AS INT) FROM f_seg) FROM c_seg WHERE n < 80)""",
    """c_prio AS (SELECT p AS v, count(*) AS n FROM (SELECT CASE WHEN lower(prio) IN ('5-low') THEN NULL ELSE prio END AS p FROM rec
    WHERE lower(seg) <> 'household') WHERE p IS NOT NULL GROUP BY p),
f_prio AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM c_prio WHERE n >= 80),
d_prio AS (SELECT v, code FROM f_prio UNION ALL SELECT v, (SELECT CAST(count(*) AS INT) FROM f_prio) FROM c_prio WHERE n < 80)"""))
def q_prepare_records(spark, sf):
    from sparkfill.operators.prepare import prepare_records
    from sparkfill.session import read_table
    rec = records(spark, sf)
    lk = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("dep_score"))
    raw = missing_view(rec)
    df, _, _ = prepare_records(raw, truth_view(rec), lk, "row_id", "area",
                               truth_sentinels={"seg": ["household"]}, sentinels={"prio": ["5-LOW"]},
                               scale={"price": (0.001, "price_k")}, drop=["acct"], encode_cols=["seg", "prio"])
    return round_doubles(df.select("row_id", "district", "area", "dep_score", "n_items", "qty", "price_k", "site",
                                   "flag", "weight", "seg", "prio"))
