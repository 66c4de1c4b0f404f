"""Queries: scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import clip, fmt2, round_doubles
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec
from sparkfill.session import read_table


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("math_scalars", with_rec("""SELECT row_id, round(abs(qty - 100), 6) AS qty_dev, round_even(price / 7, 2) AS price7,
  round(greatest(2500, least(3500, weight)), 6) AS weight_clip, round(sqrt(qty), 6) AS qty_sqrt,
  round(pow(qty, 2), 6) AS qty_sq, round(acct * 0.5, 6) AS acct_half, round_even(weight / 100, 0) AS weight_h FROM rec"""))
def q_math_scalars(spark, sf):
    o = _obs(spark, sf)
    return round_doubles(o.select(
        "row_id", F.abs(F.col("qty") - 100).alias("qty_dev"), F.bround(F.col("price") / 7, 2).alias("price7"),
        clip("weight", 2500.0, 3500.0).alias("weight_clip"), F.sqrt("qty").alias("qty_sqrt"),
        F.pow("qty", 2).alias("qty_sq"), (F.col("acct") * 0.5).alias("acct_half"),
        F.rint(F.col("weight") / 100).alias("weight_h")))


@query("string_scalars", with_rec("""SELECT row_id, printf('%.2f', price) AS price_txt, concat_ws('|', seg, prio) AS joined,
  ends_with(prio, 'URGENT') AS is_urgent, contains(seg, 'MACH') AS is_mach,
  concat('record ', cast(row_id AS varchar), ': ', seg) AS label FROM rec"""))
def q_string_scalars(spark, sf):
    o = _obs(spark, sf)
    return o.select("row_id", fmt2("price").alias("price_txt"), F.concat_ws("|", "seg", "prio").alias("joined"),
                    F.col("prio").endswith("URGENT").alias("is_urgent"), F.col("seg").contains("MACH").alias("is_mach"),
                    F.concat(F.lit("record "), F.col("row_id").cast("string"), F.lit(": "), F.col("seg")).alias("label"))


@query("null_scalars", with_rec("""SELECT row_id, weight IS NULL AS w_null, flag IS NOT NULL AS f_known,
  nullif(n_items, 0) AS n_items, round(coalesce(weight, -1.0), 6) AS weight,
  CASE WHEN area IS NULL THEN true_area ELSE area END AS area FROM rec"""))
def q_null_scalars(spark, sf):
    r = records(spark, sf)
    return round_doubles(r.select(
        "row_id", F.col("weight").isNull().alias("w_null"), F.col("flag").isNotNull().alias("f_known"),
        F.nullif(F.col("n_items"), F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce(F.col("weight"), F.lit(-1.0)).alias("weight"),
        F.when(F.col("area").isNull(), F.col("true_area")).otherwise(F.col("area")).alias("area")))


@query("json_scalars", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k,
  json_extract(props, '$.k') IS NOT NULL AS valid,
  to_json({'event_id': event_id, 'k': CAST(json_extract(props, '$.k') AS INT)}) AS body FROM events""")
def q_json_scalars(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "props")
    p = ev.withColumn("p", F.from_json("props", "k int"))
    return p.select("event_id", F.col("p.k").alias("k"), F.col("p.k").isNotNull().alias("valid"),
                    F.to_json(F.struct("event_id", F.col("p.k").alias("k"))).alias("body"))


@query("array_map_scalars", with_rec("""SELECT district, list_min(codes) AS min_code, coalesce(list_position(codes, 5), 0) AS pos_of_5,
  codes[1] AS first_code, array_to_string(list_transform(codes, lambda x: x * 10), ',') AS tens, len(codes) AS n_codes
  FROM (SELECT district, list_sort(list_distinct(list(area))) AS codes FROM rec WHERE area IS NOT NULL GROUP BY district) x"""))
def q_array_map_scalars(spark, sf):
    o = _obs(spark, sf)
    g = o.groupBy("district").agg(F.sort_array(F.collect_set("area")).alias("codes"))
    return g.select("district", F.array_min("codes").alias("min_code"),
                    F.array_position("codes", 5).alias("pos_of_5"), F.element_at("codes", 1).alias("first_code"),
                    F.array_join(F.transform("codes", lambda x: (x * 10).cast("string")), ",").alias("tens"),
                    F.size("codes").cast("bigint").alias("n_codes"))
