"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import clean, joins
from sparkfill.operators.impute import simple
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, truth_view, with_rec
from sparkfill.session import read_table


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("lookup_left_join", with_rec("""SELECT row_id, area, n_name, r_name FROM rec
  LEFT JOIN (SELECT n_nationkey AS area, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) lk USING (area)"""))
def q_lookup_left_join(spark, sf):
    nation = read_table(spark, sf, "nation")
    region = read_table(spark, sf, "region")
    lk = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("area"), "n_name", "r_name")
    return joins.lookup_left_join(_obs(spark, sf).select("row_id", "area"), lk, "area")


@query("align_columns", with_rec("SELECT row_id, weight, true_weight AS weight_true FROM rec"))
def q_align_columns(spark, sf):
    rec = records(spark, sf)
    truth = truth_view(rec)
    return joins.align_columns(missing_view(rec).select("row_id", "weight"), truth, ["weight"],
                               rename={"weight": "weight_true"})


@query("semi_join_truth", with_rec("""SELECT row_id, seg, weight FROM rec WHERE row_id IN (
  SELECT row_id FROM rec WHERE CASE WHEN lower(seg) = 'household' THEN NULL ELSE seg END IS NOT NULL)"""))
def q_semi_join_truth(spark, sf):
    rec = records(spark, sf)
    truth = clean.sentinel_to_null(truth_view(rec), {"seg": ["household"]})
    return joins.semi_join_truth(missing_view(rec).select("row_id", "seg", "weight"), truth)


@query("nearest_code_join", with_rec("""SELECT row_id, site / 10 AS v,
  first(k ORDER BY abs(k - site / 10), k) AS code FROM rec,
  (SELECT DISTINCT area::double AS k FROM rec WHERE area IS NOT NULL) c GROUP BY row_id, site"""))
def q_nearest_code_join(spark, sf):
    obs = _obs(spark, sf)
    vals = obs.select("row_id", (F.col("site") / 10).alias("v"))
    codes = obs.where(F.col("area").isNotNull()).select("area").distinct()
    return joins.nearest_code_join(vals, "v", codes, "area", out="code")


@query("attach_cluster", with_rec("SELECT row_id, weight, district AS cluster FROM rec WHERE district = 2"))
def q_attach_cluster(spark, sf):
    obs = _obs(spark, sf)
    clusters = obs.select("row_id", F.col("district").alias("cluster"))
    return joins.attach_cluster(obs.select("row_id", "weight"), clusters, only=2)


@query("compare_counts", with_rec("""SELECT coalesce(t.flag, i.flag) AS flag, coalesce(n_true, 0) AS n_true,
  coalesce(n_imputed, 0) AS n_imputed FROM
  (SELECT true_flag AS flag, count(*) AS n_true FROM rec WHERE flag IS NULL GROUP BY 1) t FULL JOIN
  (SELECT pred AS flag, count(*) AS n_imputed FROM rec JOIN m USING (seg) WHERE rec.flag IS NULL GROUP BY 1) i
  ON t.flag = i.flag""", """m AS (SELECT seg, min_by(flag, (-n, flag)) AS pred FROM
   (SELECT seg, flag, count(*) AS n FROM rec WHERE flag IS NOT NULL GROUP BY seg, flag) GROUP BY seg)"""))
def q_compare_counts(spark, sf):
    rec = records(spark, sf)
    cnt = rec.where(F.col("flag").isNotNull()).groupBy("seg", "flag").agg(F.count(F.lit(1)).alias("n"))
    m = cnt.groupBy("seg").agg(F.min_by("flag", F.struct((-F.col("n")).alias("n"), F.col("flag"))).alias("pred"))
    hidden = rec.where(F.col("flag").isNull())
    truth = hidden.select(F.col("true_flag").alias("flag"))
    imputed = hidden.join(m, "seg").select(F.col("pred").alias("flag"))
    return joins.compare_counts(truth, imputed, "flag")


@query("write_back", with_rec("""SELECT row_id, round(coalesce(weight, CASE WHEN weight IS NULL THEN s.m END), 6) AS weight
  FROM rec, (SELECT avg(weight) AS m FROM rec) s"""))
def q_write_back(spark, sf):
    obs = _obs(spark, sf)
    m = simple.fill_values(obs, ["weight"], "mean")["weight"]
    fills = obs.where(F.col("weight").isNull()).select("row_id", F.lit(m).alias("value"))
    return round_doubles(joins.write_back(obs.select("row_id", "weight"), fills, "weight"))
