"""Queries: synthetic data and quality (J1-J11). One synthetic record per order key."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkfill.functions.hashing import sql_normal, sql_u
from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import copula, synth
from sparkfill.plans.catalog import query
from sparkfill.plans.records import records, truth_view, with_rec
from sparkfill.session import read_table


def _keys(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))


# ---- DuckDB spellings of the generators ----

def s_normal(seed, mean, std):
    return f"({mean!r} + {std!r} * {sql_normal(seed, 'row_id')})"


def s_pair(seed, m1, s1, m2, s2, r):
    z1, e = sql_normal(f"{seed}.a", "row_id"), sql_normal(f"{seed}.b", "row_id")
    return (f"({m1!r} + {s1!r} * {z1})",
            f"({m2!r} + {s2!r} * ({r!r} * {z1} + {math.sqrt(1 - r * r)!r} * {e}))")


def s_cat(seed, values, probs):
    x = sql_u(seed, "row_id")
    cum = synth.cumulative_thresholds(probs)
    parts = " ".join(f"WHEN {x} < {c!r}::DOUBLE THEN {v}" for v, c in zip(values[:-1], cum[:-1]))
    return f"(CASE {parts} ELSE {values[-1]} END)" if parts else str(values[-1])


def s_clip(x, lo, hi):
    return f"greatest({float(lo)!r}, least({float(hi)!r}, round_even({x}, 0)))"


def s_shift(x, by, shifts):
    adds = " + ".join(f"CASE WHEN {by} = {k} THEN {float(a)!r} ELSE 0.0 END" for k, a in shifts.items() if a)
    return f"({x} + {adds})" if adds else x


def _gen_sql(seed="42"):
    s = lambda n: f"{seed}:{n}"
    a1, a2 = s_pair(s("apgar"), *synth.APGAR_1, *synth.APGAR_2, synth.CORR_APGAR)
    bw, ga = s_pair(s("weight_gest"), *synth.BIRTH_WEIGHT, *synth.GEST_AGE, synth.CORR_WEIGHT_GEST)
    base = f"""g0 AS (SELECT o_orderkey AS row_id FROM orders),
g1 AS (SELECT row_id, {s_clip(bw, *synth.WEIGHT_CLIP)} AS birth_weight, {s_clip(ga, *synth.GEST_CLIP)} AS gest_age,
  {s_cat(s('smoking'), *synth.SMOKING)} AS mat_smoking, {s_cat(s('breastfeed'), *synth.BREASTFEED)} AS breastfeed_birth,
  {s_cat(s('birth_order'), *synth.BIRTH_ORDER)} AS birth_order, {s_clip(a1, *synth.APGAR_CLIP)} AS apgar_1,
  {s_clip(a2, *synth.APGAR_CLIP)} AS apgar_2, {s_clip(s_normal(s('mat_age'), *synth.MAT_AGE), *synth.MAT_AGE_CLIP)} AS mat_age
  FROM g0),
g2 AS (SELECT row_id, {s_shift(s_shift('birth_weight', 'mat_smoking', synth.SMOKER_WEIGHT_SHIFT), 'birth_order', synth.ORDER_WEIGHT_SHIFT)} AS birth_weight,
  {s_shift('gest_age', 'birth_order', synth.ORDER_GEST_SHIFT)} AS gest_age, mat_smoking, breastfeed_birth, birth_order,
  apgar_1, apgar_2, mat_age,
  CAST({sql_u(s('breastfeed_8wks'), 'row_id')} < CASE WHEN breastfeed_birth = 1 THEN {synth.BREASTFEED_8WK_RATE[0]!r}
       ELSE {synth.BREASTFEED_8WK_RATE[1]!r} END AS INT) AS breastfeed_8wks,
  {s_cat(s('ethnic'), *synth.ETHNIC)} AS ethnic_group, {s_cat(s('sex'), *synth.SEX)} AS child_sex,
  {s_cat(s('labour'), *synth.LABOUR)} AS labour_onset, {s_cat(s('stillbirth'), *synth.PREV_STILLBIRTH)} AS prev_stillbirth,
  {s_cat(s('livebirths'), *synth.PREV_LIVEBIRTHS)} AS prev_livebirths,
  CAST(floor({sql_u(s('region'), 'row_id')} * {synth.REGION_COUNT}) + 0 AS INT) AS mat_region FROM g1)"""
    return base


GEN_COLS = ["birth_weight", "gest_age", "mat_smoking", "breastfeed_birth", "birth_order", "apgar_1", "apgar_2",
            "mat_age", "breastfeed_8wks", "ethnic_group", "child_sex", "labour_onset", "prev_stillbirth",
            "prev_livebirths", "mat_region"]


@query("gen_normal", f"SELECT o_orderkey AS row_id, round({s_normal('42:mat_age', *synth.MAT_AGE).replace('row_id', 'o_orderkey')}, 6) AS mat_age FROM orders")
def q_gen_normal(spark, sf):
    k = _keys(spark, sf)
    return round_doubles(k.select("row_id", synth.gen_normal(F.col("row_id"), "42:mat_age", *synth.MAT_AGE).alias("mat_age")))


_BW, _GA = s_pair("42:weight_gest", *synth.BIRTH_WEIGHT, *synth.GEST_AGE, synth.CORR_WEIGHT_GEST)


@query("gen_correlated_pair", f"""SELECT row_id, round({_BW}, 6) AS birth_weight, round({_GA}, 6) AS gest_age
  FROM (SELECT o_orderkey AS row_id FROM orders)""")
def q_gen_correlated_pair(spark, sf):
    k = _keys(spark, sf)
    bw, ga = synth.gen_correlated_pair(F.col("row_id"), "42:weight_gest", *synth.BIRTH_WEIGHT, *synth.GEST_AGE,
                                       synth.CORR_WEIGHT_GEST)
    return round_doubles(k.select("row_id", bw.alias("birth_weight"), ga.alias("gest_age")))


@query("gen_weighted_category", f"""SELECT row_id, {s_cat('42:labour', *synth.LABOUR)} AS labour_onset,
  CAST(floor({sql_u('42:region', 'row_id')} * {synth.REGION_COUNT}) AS INT) AS mat_region
  FROM (SELECT o_orderkey AS row_id FROM orders)""")
def q_gen_weighted_category(spark, sf):
    k = _keys(spark, sf)
    return k.select("row_id", synth.gen_weighted_category(F.col("row_id"), "42:labour", *synth.LABOUR).alias("labour_onset"),
                    synth.gen_uniform_int(F.col("row_id"), "42:region", 0, synth.REGION_COUNT).alias("mat_region"))


@query("clip_round", f"""SELECT row_id, {s_clip(_BW, *synth.WEIGHT_CLIP)} AS birth_weight,
  {s_clip(_GA, *synth.GEST_CLIP)} AS gest_age FROM (SELECT o_orderkey AS row_id FROM orders)""")
def q_clip_round(spark, sf):
    k = _keys(spark, sf)
    bw, ga = synth.gen_correlated_pair(F.col("row_id"), "42:weight_gest", *synth.BIRTH_WEIGHT, *synth.GEST_AGE,
                                       synth.CORR_WEIGHT_GEST)
    return k.select("row_id", synth.clip_round(bw, *synth.WEIGHT_CLIP).alias("birth_weight"),
                    synth.clip_round(ga, *synth.GEST_CLIP).alias("gest_age"))


@query("shift_by_category", "WITH " + _gen_sql() + "\nSELECT row_id, birth_weight, gest_age FROM g2")
def q_shift_by_category(spark, sf):
    return synth.generate_table(_keys(spark, sf), "row_id").select("row_id", "birth_weight", "gest_age")


@query("gen_conditional_flag", "WITH " + _gen_sql() + "\nSELECT row_id, breastfeed_birth, breastfeed_8wks FROM g2")
def q_gen_conditional_flag(spark, sf):
    return synth.generate_table(_keys(spark, sf), "row_id").select("row_id", "breastfeed_birth", "breastfeed_8wks")


@query("generate_table", "WITH " + _gen_sql() + "\nSELECT row_id, " + ", ".join(GEN_COLS) + " FROM g2")
def q_generate_table(spark, sf):
    return synth.generate_table(_keys(spark, sf), "row_id")


# ---- learned from rec, nulls and all ----
LEARN_NUM = ["acct", "n_items", "qty", "price", "weight"]
LEARN_CAT = ["district", "area", "seg", "prio", "flag"]


def _learned(spark, sf):
    real = records(spark, sf).select("row_id", *LEARN_NUM, *LEARN_CAT)
    return real, copula.fit(real, LEARN_NUM, LEARN_CAT)


@query("fit_sample_synthesizer")
def q_fit_sample_synthesizer(spark, sf):
    real, model = _learned(spark, sf)
    return round_doubles(copula.sample(spark, model, real.count()))


@query("synthesizer_parameters")
def q_synthesizer_parameters(spark, sf):
    return round_doubles(copula.parameters(spark, _learned(spark, sf)[1]))


# ---- real (truth of rec) versus its parametric twin ----
TW_NUM = ["qty", "price", "weight"]
TW_CAT = ["seg", "prio", "flag"]


def _twin(spark, sf):
    real = truth_view(records(spark, sf)).select("row_id", *TW_NUM, *TW_CAT)
    params = synth.fit_twin(real, TW_NUM, TW_CAT)
    return real, synth.sample_twin(real.select("row_id"), "row_id", params)


def _twin_sql_ctes():
    real = "rl AS (SELECT row_id, qty, price, true_weight AS weight, seg, prio, true_flag AS flag FROM rec)"
    st = "pm AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in TW_NUM) + " FROM rl)"
    shares = []
    for c in TW_CAT:
        shares.append(f"""sh_{c} AS (SELECT {c} AS v, sum(n / t) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  row_number() OVER (ORDER BY {c} DESC) = 1 AS is_last
  FROM (SELECT {c}, count(*)::double AS n, sum(count(*)) OVER ()::double AS t FROM rl WHERE {c} IS NOT NULL GROUP BY {c}))""")
    cols = [f"pm.m_{c} + pm.s_{c} * {sql_normal('twin:' + c, 'rl.row_id')} AS {c}" for c in TW_NUM]
    for c in TW_CAT:
        x = sql_u("twin:" + c, "rl.row_id")
        cols.append(f"""coalesce((SELECT min_by(v, cum) FROM sh_{c} WHERE NOT is_last AND {x} < cum),
                              (SELECT v FROM sh_{c} WHERE is_last)) AS {c}""")
    tw = "sy AS (SELECT rl.row_id, " + ",\n  ".join(cols) + " FROM rl, pm)"
    return [real, st, *shares, tw]


@query("validate_table", with_rec("""
SELECT "column", metric, round(score, 6) AS score FROM (
  """ + "\n  UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'validity' AS metric, avg((sy.{c} BETWEEN r.mn AND r.mx)::int::double) AS score "
     f"FROM sy, (SELECT min({c}) mn, max({c}) mx FROM rl) r" for c in TW_NUM]
    + [f"SELECT '{c}', 'validity', avg(CASE WHEN sy.{c} IN (SELECT {c} FROM rl WHERE {c} IS NOT NULL) THEN 1.0 ELSE 0.0 END) "
       f"FROM sy WHERE sy.{c} IS NOT NULL" for c in TW_CAT]
    + ["SELECT 'row_id', 'key_uniqueness', count(DISTINCT row_id) / count(*) FROM sy",
       "SELECT '*', 'structure', 1.0"]) + ") x", *_twin_sql_ctes()))
def q_validate_table(spark, sf):
    real, syn = _twin(spark, sf)
    return round_doubles(synth.validate_table(real, syn, "row_id", TW_NUM, TW_CAT))


def _shape_sql():
    parts = []
    for c in TW_NUM:
        parts.append(f"""SELECT '{c}' AS "column", 'ks_complement' AS metric, 1 - max(abs(cr / nr - cs / ns)) AS score FROM (
  SELECT v, sum(a) OVER (ORDER BY v) AS cr, sum(b) OVER (ORDER BY v) AS cs, sum(a) OVER () AS nr, sum(b) OVER () AS ns FROM (
    SELECT v, sum(a) a, sum(b) b FROM (SELECT {c}::double AS v, 1 AS a, 0 AS b FROM rl WHERE {c} IS NOT NULL
      UNION ALL SELECT {c}::double, 0, 1 FROM sy WHERE {c} IS NOT NULL) GROUP BY v))""")
    for c in TW_CAT:
        parts.append(f"""SELECT '{c}', 'tv_complement', 1 - 0.5 * sum(abs(coalesce(pr, 0) - coalesce(ps, 0))) FROM
  (SELECT cast({c} AS varchar) AS v, count(*) / sum(count(*)) OVER () AS pr FROM rl WHERE {c} IS NOT NULL GROUP BY 1) a
  FULL JOIN (SELECT cast({c} AS varchar) AS v, count(*) / sum(count(*)) OVER () AS ps FROM sy WHERE {c} IS NOT NULL GROUP BY 1) b USING (v)""")
    return with_rec('SELECT "column", metric, round(score, 6) AS score FROM (' + "\nUNION ALL ".join(parts) + ") x",
                    *_twin_sql_ctes())


@query("column_shape_score", _shape_sql())
def q_column_shape_score(spark, sf):
    real, syn = _twin(spark, sf)
    return round_doubles(synth.column_shape_score(real, syn, TW_NUM, TW_CAT))


def _pair_sql():
    parts = []
    for i, a in enumerate(TW_NUM):
        for b in TW_NUM[i + 1:]:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, 'correlation_similarity' AS metric,
  1 - abs((SELECT corr({a}, {b}) FROM rl) - (SELECT corr({a}, {b}) FROM sy)) / 2 AS score""")
    for i, a in enumerate(TW_CAT):
        for b in TW_CAT[i + 1:]:
            parts.append(f"""SELECT '{a}', '{b}', 'contingency_similarity', 1 - 0.5 * sum(abs(coalesce(pr, 0) - coalesce(ps, 0))) FROM
  (SELECT cast({a} AS varchar) va, cast({b} AS varchar) vb, count(*) / sum(count(*)) OVER () AS pr FROM rl
     WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) x
  FULL JOIN (SELECT cast({a} AS varchar) va, cast({b} AS varchar) vb, count(*) / sum(count(*)) OVER () AS ps FROM sy
     WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) y USING (va, vb)""")
    for a in TW_NUM:
        cuts = f"(SELECT quantile_cont({a}::DOUBLE, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS q FROM rl)"
        for b in TW_CAT:
            x, y = (f"""(SELECT len(list_filter(q, lambda c: {a}::DOUBLE > c)) va, cast({b} AS varchar) vb, count(*) / sum(count(*)) OVER () AS {p}
     FROM {t}, {cuts} e WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)""" for t, p in (("rl", "pr"), ("sy", "ps")))
            parts.append(f"""SELECT '{a}', '{b}', 'binned_contingency_similarity', 1 - 0.5 * sum(abs(coalesce(pr, 0) - coalesce(ps, 0)))
  FROM {x} x FULL JOIN {y} y USING (va, vb)""")
    return with_rec("SELECT a, b, metric, round(score, 6) AS score FROM (" + "\nUNION ALL ".join(parts) + ") z",
                    *_twin_sql_ctes())


@query("pair_trend_score", _pair_sql())
def q_pair_trend_score(spark, sf):
    real, syn = _twin(spark, sf)
    return round_doubles(synth.pair_trend_score(real, syn, TW_NUM, TW_CAT))
