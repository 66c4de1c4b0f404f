"""Queries: projections, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import clean
from sparkfill.operators.impute import simple
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("sentinel_to_null", with_rec("""
SELECT row_id, CASE WHEN n_items IN (0) THEN NULL ELSE n_items END AS n_items,
  CASE WHEN lower(seg) IN ('household') THEN NULL ELSE seg END AS seg,
  CASE WHEN lower(prio) IN ('5-low') THEN NULL ELSE prio END AS prio FROM rec"""))
def q_sentinel(spark, sf):
    df = clean.sentinel_to_null(_obs(spark, sf), {"n_items": [0], "seg": ["household"], "prio": ["5-LOW"]})
    return df.select("row_id", "n_items", "seg", "prio")


@query("rename_columns", with_rec("SELECT row_id, true_area AS area, true_flag AS flag, true_weight AS weight FROM rec"))
def q_rename(spark, sf):
    rec = records(spark, sf).select("row_id", "true_area", "true_flag", "true_weight")
    return clean.strip_prefix(rec, "true_")


@query("drop_by_rule", with_rec(
    "SELECT row_id, district, area, seg, prio, n_items, qty, price, flag, weight FROM rec"))
def q_drop_by_rule(spark, sf):
    return clean.drop_by_rule(records(spark, sf), lambda c: not c.startswith("true_"), ["site", "acct"])


@query("project", with_rec("SELECT row_id, seg, weight FROM rec"))
def q_project(spark, sf):
    return clean.project(_obs(spark, sf), ["row_id", "seg", "weight"])


@query("unit_scale", with_rec("SELECT row_id, round(cast(weight AS double) * 0.001, 6) AS weight_kg FROM rec"))
def q_unit_scale(spark, sf):
    df = clean.unit_scale(_obs(spark, sf), "weight", 0.001, "weight_kg")
    return round_doubles(df.select("row_id", "weight_kg"))


@query("range_filter", with_rec("""SELECT row_id FROM rec WHERE coalesce(qty BETWEEN 20 AND 150, false)
  AND coalesce(price BETWEEN 10000 AND 300000, false) AND coalesce(weight BETWEEN 2700 AND 3300, false)"""))
def q_range_filter(spark, sf):
    df = clean.range_filter(_obs(spark, sf), {"qty": (20, 150), "price": (10000, 300000), "weight": (2700, 3300)})
    return df.select("row_id")


@query("drop_nulls", with_rec("SELECT row_id, flag, weight FROM rec WHERE flag IS NOT NULL AND weight IS NOT NULL"))
def q_drop_nulls(spark, sf):
    return clean.drop_nulls(_obs(spark, sf).select("row_id", "flag", "weight"), ["flag", "weight"])


@query("fill_constant", with_rec("""SELECT row_id, coalesce(area, -1) AS area, coalesce(flag, -1) AS flag,
  coalesce(weight, -1.0) AS weight FROM rec"""))
def q_fill_constant(spark, sf):
    return clean.fill_constant(_obs(spark, sf).select("row_id", "area", "flag", "weight"), -1)


@query("null_mask", with_rec("""SELECT row_id, CAST((area IS NULL)::int + 2*(flag IS NULL)::int
  + 4*(weight IS NULL)::int AS BIGINT) AS null_mask FROM rec"""))
def q_null_mask(spark, sf):
    return clean.null_mask(_obs(spark, sf), ["area", "flag", "weight"]).select("row_id", "null_mask")


@query("missing_indicators", with_rec("""SELECT row_id, (area IS NULL)::int AS area_missing,
  (flag IS NULL)::int AS flag_missing, (weight IS NULL)::int AS weight_missing FROM rec"""))
def q_missing_indicators(spark, sf):
    df = clean.missing_indicators(_obs(spark, sf).select("row_id", "area", "flag", "weight"), ["area", "flag", "weight"])
    return df.drop("area", "flag", "weight")


@query("drop_all_null_columns", with_rec("""
SELECT district, "column", n_present, (n_present > 0)::int AS usable FROM (
  SELECT district, 'area' AS "column", count(area) AS n_present FROM rec GROUP BY district
  UNION ALL SELECT district, 'flag', count(flag) FROM rec GROUP BY district
  UNION ALL SELECT district, 'weight', count(weight) FROM rec GROUP BY district
  UNION ALL SELECT district, 'acct', count(acct) FROM rec GROUP BY district) x"""))
def q_drop_all_null(spark, sf):
    return clean.usable_columns_by_group(_obs(spark, sf), "district", ["area", "flag", "weight", "acct"])


@query("keep_dense_columns", with_rec("SELECT row_id, district, seg, prio, acct, n_items, qty, price, site FROM rec"))
def q_keep_dense(spark, sf):
    return clean.keep_dense_columns(_obs(spark, sf), max_ratio=0.10)


@query("round_frame", with_rec("""SELECT row_id, round_even(acct, 2) AS acct, round_even(price / 7, 2) AS price7,
  round_even(qty / 3, 2) AS qty3 FROM rec"""))
def q_round_frame(spark, sf):
    df = _obs(spark, sf).select("row_id", "acct", (F.col("price") / 7).alias("price7"), (F.col("qty") / 3).alias("qty3"))
    return clean.round_frame(df, 2, ["acct", "price7", "qty3"])


@query("round_to_code", with_rec("""SELECT row_id, cast(round_even(coalesce(cast(flag AS double), s.f), 0) AS int) AS flag,
  cast(round_even(coalesce(cast(area AS double), s.a), 0) AS int) AS area
  FROM rec, (SELECT avg(flag) f, avg(area) a FROM rec) s"""))
def q_round_to_code(spark, sf):
    filled = simple.impute_constant(_obs(spark, sf).select("row_id", "flag", "area"), ["flag", "area"], "mean")
    return clean.round_to_code(filled, ["flag", "area"])


@query("case_bins", with_rec("""SELECT row_id, CASE WHEN weight <= 2500 THEN 1 WHEN weight <= 3000 THEN 2
  WHEN weight <= 3500 THEN 3 WHEN weight <= 4000 THEN 4 WHEN weight <= 4500 THEN 5
  WHEN weight IS NOT NULL THEN 6 END AS weight_band FROM rec"""))
def q_case_bins(spark, sf):
    return _obs(spark, sf).select(
        "row_id", clean.case_bins("weight", [2500, 3000, 3500, 4000, 4500], [1, 2, 3, 4, 5, 6]).alias("weight_band"))


PRIO_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified"}


@query("map_labels", with_rec("""SELECT row_id, CASE prio WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
  WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified' END AS prio_label,
  CASE WHEN contains(seg, 'MACH') THEN 'machines' WHEN contains(seg, 'BUIL') THEN 'building' ELSE 'other' END AS seg_label
  FROM rec"""))
def q_map_labels(spark, sf):
    return _obs(spark, sf).select(
        "row_id", clean.map_labels("prio", PRIO_LABELS).alias("prio_label"),
        clean.label_by_substring("seg", [("MACH", "machines"), ("BUIL", "building")], "other").alias("seg_label"))


@query("in_list_filter", with_rec("""SELECT row_id, district, cand FROM (
  SELECT row_id, district, cast(round_even(site / 10, 0) AS int) AS cand FROM rec) r
  WHERE EXISTS (SELECT 1 FROM rec t WHERE t.area IS NOT NULL AND t.district = r.district AND t.area = r.cand)"""))
def q_in_list_filter(spark, sf):
    obs = _obs(spark, sf)
    block_codes = obs.where(F.col("area").isNotNull()).select("district", F.col("area").alias("cand"))
    df = obs.select("row_id", "district", F.rint(F.col("site") / 10).cast("int").alias("cand"))
    return clean.in_list_filter(df, "district", "cand", block_codes)


@query("category_codes", with_rec("""SELECT row_id,
  cast(dense_rank() OVER (ORDER BY seg) - 1 AS int) AS seg_code,
  cast(dense_rank() OVER (ORDER BY prio) - 1 AS int) AS prio_code FROM rec"""))
def q_category_codes(spark, sf):
    df = clean.category_codes(_obs(spark, sf).select("row_id", "seg", "prio"), ["seg", "prio"])
    return df.select("row_id", "seg_code", "prio_code")


DOMAINS = {"seg": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
           "prio": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


@query("reject_trailer_rows", with_rec("""SELECT row_id, seg, prio, weight FROM rec
  WHERE coalesce(cast(row_id AS varchar), seg, prio, cast(weight AS varchar)) IS NOT NULL
  AND (seg IS NULL OR seg IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'))
  AND (prio IS NULL OR prio IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'))"""))
def q_reject_trailer(spark, sf):
    from sparkfill.sources.files import reject_trailer_rows
    kept, _rejects = reject_trailer_rows(_obs(spark, sf).select("row_id", "seg", "prio", "weight"), DOMAINS)
    return kept

