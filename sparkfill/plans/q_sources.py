"""Queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators.impute import simple
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec
from sparkfill.session import read_table, shared_path
from sparkfill.sources import files

REC_SCHEMA = ("row_id bigint, district int, area int, seg string, prio string, acct double, n_items bigint, "
              "qty double, price double, site double, flag int, weight double")


@query("scan_csv", with_rec(
    "SELECT row_id, district, area, seg, prio, acct, n_items, qty, price, site, flag, weight FROM rec"))
def q_scan_csv(spark, sf):
    path = shared_path(spark, "scan_csv")
    files.sink_table(missing_view(records(spark, sf)), path, fmt="csv")
    return files.scan_csv(spark, path, REC_SCHEMA)


@query("scan_folder", with_rec("""
SELECT 'features' AS "table", count(*) AS n_rows, 5 AS n_cols FROM rec
UNION ALL SELECT 'keys', count(*), 3 FROM rec
UNION ALL SELECT 'targets', count(*), 4 FROM rec"""))
def q_scan_folder(spark, sf):
    obs = missing_view(records(spark, sf))
    base = shared_path(spark, "scan_folder")
    parts = {"keys": ["row_id", "district", "seg"], "targets": ["row_id", "area", "flag", "weight"],
             "features": ["row_id", "acct", "n_items", "qty", "price"]}
    for name, cols in parts.items():
        files.sink_table(obs.select(*cols), f"{base}/{name}", fmt="csv")
    out = None
    for name, t in files.scan_folder(spark, base).items():
        row = t.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(t.columns)).alias("n_cols"))
        out = row if out is None else out.unionByName(row)
    return out


def _metadata_sql():
    cols = {"row_id": "id", "district": None, "area": None, "seg": "str", "prio": "str", "acct": None,
            "n_items": None, "qty": None, "price": None, "site": None, "flag": None, "weight": None}
    parts = []
    for c, kind in cols.items():
        if kind == "id":
            sd = "'id'"
        elif kind == "str":
            sd = "'categorical'"
        else:
            sd = ("CASE WHEN count(DISTINCT {c}) <= 2 THEN 'boolean' WHEN count(DISTINCT {c}) <= 30 "
                  "THEN 'categorical' ELSE 'numerical' END").format(c=c)
        parts.append(f"SELECT '{c}' AS \"column\", {sd} AS sdtype, count(*) AS n_rows, "
                     f"count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM rec")
    return with_rec("\nUNION ALL ".join(parts))


@query("detect_metadata", _metadata_sql())
def q_detect_metadata(spark, sf):
    return files.detect_metadata(missing_view(records(spark, sf)), key="row_id")


@query("scan_keyed", "SELECT o_orderkey AS row_id, o_custkey, o_totalprice FROM orders")
def q_scan_keyed(spark, sf):
    df = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return files.scan_keyed(df, "o_orderkey")


@query("sink_csv", with_rec("""SELECT 'mean' AS method, 'none' AS selection, 'none' AS clustering, 42 AS seed,
  count(*) AS n, round(sum(coalesce(weight, (SELECT avg(weight) FROM rec))), 2) AS sum_weight FROM rec"""))
def q_sink_csv(spark, sf):
    obs = missing_view(records(spark, sf))
    filled = simple.impute_constant(obs, ["weight"], "mean").select(
        "row_id", "weight", F.lit("mean").alias("method"), F.lit("none").alias("selection"),
        F.lit("none").alias("clustering"), F.lit(42).alias("seed"))
    path = shared_path(spark, "sink_csv")
    files.sink_table(filled, path, ["method", "selection", "clustering", "seed"], fmt="csv")
    back = spark.read.option("header", True).schema("row_id bigint, weight double").csv(path)
    return back.groupBy("method", "selection", "clustering", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 2).alias("sum_weight"))


@query("trace_store", with_rec("""SELECT 'weight' AS target, row_id, round((SELECT avg(weight) FROM rec), 6) AS value
  FROM rec WHERE weight IS NULL"""))
def q_trace_store(spark, sf):
    obs = missing_view(records(spark, sf))
    m = simple.fill_values(obs, ["weight"], "mean")["weight"]
    values = obs.where(F.col("weight").isNull()).select(
        F.lit("weight").alias("target"), "row_id", F.lit(m).alias("value"))
    scores = spark.createDataFrame([("weight", "fill_value", float(m))], "target string, metric string, value double")
    base = shared_path(spark, "trace")
    files.write_trace({"trace_values": values, "trace_scores": scores}, base, ["target"])
    back = files.read_trace(spark, base, ["trace_values"])["trace_values"]
    return round_doubles(back.select("target", "row_id", "value"))
