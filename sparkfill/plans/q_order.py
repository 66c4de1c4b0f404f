"""Queries: windows, ordering, top-k and sampling."""

from __future__ import annotations



from pyspark.sql import functions as F

from sparkfill.functions.hashing import sql_hash32, sql_order_key
from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import order, profile, sampling
from sparkfill.operators.impute import simple
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, truth_view, with_rec
from sparkfill.session import read_table


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("top_bottom_k", with_rec("""SELECT district, round(sum(CASE WHEN rn_lo <= 10 THEN true_weight END), 6) AS sum_near,
  count(CASE WHEN rn_lo <= 10 THEN 1 END) AS n_near,
  round(sum(CASE WHEN rn_hi <= 10 THEN true_weight END), 6) AS sum_far, count(CASE WHEN rn_hi <= 10 THEN 1 END) AS n_far
  FROM (SELECT district, true_weight, row_number() OVER (PARTITION BY district ORDER BY price, row_id) AS rn_lo,
        row_number() OVER (PARTITION BY district ORDER BY price DESC, row_id) AS rn_hi FROM rec WHERE price IS NOT NULL) x
  GROUP BY district"""))
def q_top_bottom_k(spark, sf):
    return round_doubles(order.top_bottom_k(records(spark, sf), ["district"], "price", 10, "row_id", "true_weight"))


FEATS = ["acct", "n_items", "qty", "price", "site"]


@query("rank_features", with_rec("""SELECT "column", round(weight, 6) AS weight,
  row_number() OVER (ORDER BY weight DESC, "column") AS rank FROM (
  """ + "\n  UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs(corr({c}, weight)) AS weight FROM rec" for c in FEATS) + ") x"))
def q_rank_features(spark, sf):
    obs = _obs(spark, sf)
    one = obs.agg(*[F.abs(F.corr(c, "weight")).alias(c) for c in FEATS])
    w = one.unpivot([], FEATS, "column", "weight")
    r = order.rank_features(w)
    return r.select("column", F.round("weight", 6).alias("weight"), F.col("rank").cast("bigint").alias("rank"))


def _inertia_curve(obs):
    st = obs.agg(F.min("price").alias("mn"), F.max("price").alias("mx"), F.avg("price").alias("mu")).first()
    d = obs.where(F.col("price").isNotNull()).select(
        (F.col("price") - F.lit(st["mu"])).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    width = (st["mx"] - st["mn"]) / F.col("k")
    b = F.least(F.floor((F.col("x") + F.lit(st["mu"] - st["mn"])) / width), F.col("k") - 1)
    per = d.groupBy("k", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
                                            F.sum(F.col("x") * F.col("x")).alias("ss"))
    return per.groupBy("k").agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("inertia"))


@query("elbow_k", with_rec("""SELECT CASE WHEN rng > 0 THEN i END AS elbow_index,
  CAST(CASE WHEN rng > 0 THEN k + 1 ELSE 1 END AS INT) AS k FROM (
  SELECT i, k, rng, abs(i * (nl - n0) - (ny - n0) * m) / sqrt(m * m + (nl - n0) * (nl - n0)) AS dist FROM (
    SELECT c.*, m, (y - ymin) / (ymax - ymin) AS ny, (y0 - ymin) / (ymax - ymin) AS n0, (ylast - ymin) / (ymax - ymin) AS nl,
      ymax - ymin AS rng FROM (SELECT k - 1 AS i, k, inertia AS y FROM curve) c,
      (SELECT min(inertia) ymin, max(inertia) ymax, max(k - 1)::double m, min_by(inertia, k) y0, max_by(inertia, k) ylast FROM curve) s) a
  ) b ORDER BY dist DESC, i LIMIT 1""",
    """st AS (SELECT min(price) mn, max(price) mx, avg(price) mu FROM rec),
x AS (SELECT price - mu AS x, price, mn, mx, mu, k FROM rec, st, range(1, 11) t(k) WHERE price IS NOT NULL),
per AS (SELECT k, least(floor((x + (mu - mn)) / ((mx - mn) / k)), k - 1) AS bin, count(*) n, sum(x) s, sum(x * x) ss
        FROM x GROUP BY 1, 2),
curve AS (SELECT k, sum(ss - s * s / n) AS inertia FROM per GROUP BY k)"""))
def q_elbow_k(spark, sf):
    return order.elbow_k(_inertia_curve(_obs(spark, sf)))


@query("argmin_group", with_rec("""SELECT seg, min_by(prio, (m, prio)) AS best_prio, round(min(m), 6) AS best_value
  FROM (SELECT seg, prio, avg(weight) AS m FROM rec GROUP BY seg, prio) x GROUP BY seg"""))
def q_argmin_group(spark, sf):
    g = _obs(spark, sf).groupBy("seg", "prio").agg(F.avg("weight").alias("m"))
    return round_doubles(order.argmin_group(g, "prio", "m", ["seg"]))


SCALED = {"acct": 1000.0, "qty": 10.0, "price": 10000.0, "site": 10.0, "n_items": 1.0}


@query("cumulative_variance", with_rec("""SELECT i, "column", round(ratio, 6) AS ratio,
  round(sum(ratio) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum,
  coalesce((SELECT min(i) FROM (SELECT i, sum(ratio) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) c
            FROM r) z WHERE c >= 0.95), 0) AS n_components FROM r""",
    """v AS (""" + "\n  UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c} / {s}) AS var FROM rec"
                                           for c, s in SCALED.items()) + """),
r AS (SELECT row_number() OVER (ORDER BY var DESC, "column") AS i, "column", var / sum(var) OVER () AS ratio FROM v)"""))
def q_cumulative_variance(spark, sf):
    obs = _obs(spark, sf)
    one = obs.agg(*[F.var_samp(F.col(c) / s).alias(c) for c, s in SCALED.items()])
    v = one.unpivot([], list(SCALED), "column", "var")
    tot = v.agg(F.sum("var").alias("tot"))
    from pyspark.sql import Window
    r = v.crossJoin(tot).select("column", (F.col("var") / F.col("tot")).alias("ratio")) \
        .withColumn("i", F.row_number().over(Window.orderBy(F.desc("ratio"), "column")))
    c = order.cumulative_variance(r, "i", "ratio")
    return round_doubles(c.select(F.col("i").cast("bigint").alias("i"), "column", "ratio", "cum",
                                  F.col("n_components").cast("bigint").alias("n_components")))


@query("sample_exact_n", with_rec(f"""SELECT row_id FROM rec WHERE weight IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY {sql_order_key('s42', 'row_id')}, row_id)
    <= (SELECT floor(0.1 * count(*)) FROM rec WHERE weight IS NOT NULL)"""))
def q_sample_exact_n(spark, sf):
    known = _obs(spark, sf).where(F.col("weight").isNotNull()).select("row_id")
    n = int(0.1 * known.count())
    return sampling.sample_exact_n(known, n, "s42")


@query("stratified_sample", f"""WITH e AS (SELECT quantile_cont(o_totalprice, 0.2) e1, quantile_cont(o_totalprice, 0.4) e2,
  quantile_cont(o_totalprice, 0.6) e3, quantile_cont(o_totalprice, 0.8) e4 FROM orders),
s AS (SELECT o_orderkey AS row_id, CASE WHEN o_totalprice <= e1 THEN 0 WHEN o_totalprice <= e2 THEN 1
  WHEN o_totalprice <= e3 THEN 2 WHEN o_totalprice <= e4 THEN 3 ELSE 4 END AS stratum FROM orders, e),
sz AS (SELECT stratum, count(*) AS n, 1000.0 * count(*) / sum(count(*)) OVER () AS raw FROM s GROUP BY stratum),
al AS (SELECT stratum, floor(raw)::bigint + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum)
   <= 1000 - (SELECT sum(floor(raw)) FROM sz) THEN 1 ELSE 0 END AS quota FROM sz)
SELECT row_id, stratum FROM s JOIN al USING (stratum)
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {sql_order_key('strat', 'row_id')}, row_id) <= quota""")
def q_stratified_sample(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    edges = profile.quantile_edges(orders, "o_totalprice", q=5, fallback_equal_width=False)
    st = orders.crossJoin(F.broadcast(edges)).select("row_id", profile.bin_index("o_totalprice", "edges").alias("stratum"))
    return sampling.stratified_sample(st, "stratum", 1000, "strat")


@query("train_test_split", with_rec(f"""SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {sql_order_key('split42', 'row_id')}, row_id)
  <= (SELECT ceil(0.2 * count(*)) FROM rec WHERE weight IS NOT NULL) THEN 1 ELSE 0 END AS is_test
  FROM rec WHERE weight IS NOT NULL"""))
def q_train_test_split(spark, sf):
    known = _obs(spark, sf).where(F.col("weight").isNotNull()).select("row_id")
    return sampling.train_test_split(known, 0.2, "split42")


@query("undersample", with_rec(f"""SELECT row_id, flag FROM rec WHERE flag IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY flag ORDER BY {sql_order_key('under', 'row_id')}, row_id)
    <= (SELECT min(n) FROM (SELECT count(*) n FROM rec WHERE flag IS NOT NULL GROUP BY flag) z)"""))
def q_undersample(spark, sf):
    return sampling.undersample(_obs(spark, sf).select("row_id", "flag"), "flag", "under")


@query("kfold_assign", with_rec(f"SELECT row_id, CAST({sql_hash32('fold', 'row_id')} % 5 AS INT) AS fold FROM rec"))
def q_kfold_assign(spark, sf):
    return sampling.kfold_assign(_obs(spark, sf).select("row_id"), 5, "fold")


@query("closest_strategy", with_rec("""SELECT row_id, idx AS best_idx, round(v, 6) AS best_value FROM (
  SELECT row_id, arg_min(struct_pack(idx := idx, v := v), (d, idx)) AS b FROM (
    SELECT row_id, 0 AS idx, s.m AS v, abs(s.m - true_weight) AS d FROM rec, s WHERE weight IS NULL
    UNION ALL SELECT row_id, 1, s.med, abs(s.med - true_weight) FROM rec, s WHERE weight IS NULL
    UNION ALL SELECT row_id, 2, s.a + s.b * qty, abs(s.a + s.b * qty - true_weight) FROM rec, s WHERE weight IS NULL) x
  GROUP BY row_id) y, LATERAL (SELECT b.idx AS idx, b.v AS v)""",
    """s AS (SELECT avg(weight) m, quantile_cont(weight, 0.5) med, regr_slope(weight, qty) b,
      regr_intercept(weight, qty) a FROM rec)"""))
def q_closest_strategy(spark, sf):
    rec = records(spark, sf)
    obs = missing_view(rec)
    mean = simple.fill_values(obs, ["weight"], "mean")["weight"]
    med = simple.fill_values(obs, ["weight"], "median")["weight"]
    line = obs.agg(F.regr_slope("weight", "qty").alias("b"), F.regr_intercept("weight", "qty").alias("a")).first()
    h = rec.where(F.col("weight").isNull()).select(
        "row_id", "true_weight", F.lit(mean).alias("mean"), F.lit(med).alias("median"),
        (F.lit(line["a"]) + F.lit(line["b"]) * F.col("qty")).alias("ols_qty"))
    b = h.select("row_id", order.closest_strategy(["mean", "median", "ols_qty"], "true_weight").alias("b"))
    return b.select("row_id", F.col("b.idx").alias("best_idx"), F.round("b.value", 6).alias("best_value"))


@query("mask_random", with_rec(f"""SELECT row_id FROM rec WHERE weight IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY {sql_order_key('sim0', 'row_id')}, row_id)
   <= (SELECT floor(greatest(0.1, avg((weight IS NULL)::int)) * count(weight)) FROM rec)"""))
def q_mask_random(spark, sf):
    _, hidden = sampling.mask_random(_obs(spark, sf), "weight", "sim0")
    return hidden


PCTS = {"weight": 20, "flag": 40, "area": 80}


def _mask_pct_sql():
    cols = []
    for c, p in PCTS.items():
        cols.append(f"""CASE WHEN row_number() OVER (PARTITION BY {c} IS NULL ORDER BY {sql_order_key('pct:' + c, 'row_id')}, row_id)
          <= floor({p} * count(*) OVER () / 100) - (count(*) OVER () - count({c}) OVER ()) AND {c} IS NOT NULL
          THEN NULL ELSE {c} END AS {c}""")
    return with_rec("SELECT row_id, " + ",\n  ".join(cols) + " FROM t",
                    "t AS (SELECT row_id, true_weight AS weight, true_flag AS flag, true_area AS area FROM rec)")


@query("mask_to_percent", _mask_pct_sql())
def q_mask_to_percent(spark, sf):
    t = truth_view(records(spark, sf)).select("row_id", "weight", "flag", "area")
    return sampling.mask_to_percent(t, PCTS, "pct")



