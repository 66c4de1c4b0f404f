"""Queries: encoding and scaling."""

from __future__ import annotations

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import clean, encode
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, truth_view, with_rec


def _obs(spark, sf):
    return missing_view(records(spark, sf))


def _ord_cte(col, src="rec", name=None, min_freq=80):
    n = name or col
    return f"""c_{n} AS (SELECT {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}),
f_{n} AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM c_{n} WHERE n >= {min_freq}),
d_{n} AS (SELECT v, code FROM f_{n} UNION ALL
          SELECT v, (SELECT CAST(count(*) AS INT) FROM f_{n}) FROM c_{n} WHERE n < {min_freq})"""


@query("ordinal_encode", with_rec("""SELECT row_id, d_site.code AS site_code, d_prio.code AS prio_code, d_area.code AS area_code
  FROM rec LEFT JOIN d_site ON rec.site = d_site.v LEFT JOIN d_prio ON rec.prio = d_prio.v
  LEFT JOIN d_area ON rec.area = d_area.v""", _ord_cte("site"), _ord_cte("prio"), _ord_cte("area")))
def q_ordinal_encode(spark, sf):
    enc, _ = encode.ordinal_encode(_obs(spark, sf), ["site", "prio", "area"], 80)
    return enc.select("row_id", "site_code", "prio_code", "area_code")


@query("encode_fit_transform", with_rec("""SELECT row_id, d_t.code AS area_code, d2.code AS true_area_code
  FROM rec LEFT JOIN d_t ON rec.area = d_t.v LEFT JOIN d_t d2 ON rec.true_area = d2.v""",
    _ord_cte("true_area", name="t")))
def q_encode_fit_transform(spark, sf):
    rec = records(spark, sf)
    truth = truth_view(rec)
    dim = encode.fit_ordinal(truth, "area", 80)
    out = encode.apply_ordinal(rec.select("row_id", "area", "true_area"), "area", dim, "area_code")
    out = encode.apply_ordinal(out, "true_area", dim, "true_area_code")
    return out.select("row_id", "area_code", "true_area_code")


@query("decode_codes", with_rec("""SELECT row_id, d_site.code AS site_code,
  CASE WHEN c_site.n >= 80 THEN cast(d_site.v AS varchar) ELSE '__infrequent__' END AS site_label
  FROM rec LEFT JOIN d_site ON rec.site = d_site.v LEFT JOIN c_site ON rec.site = c_site.v""", _ord_cte("site")))
def q_decode_codes(spark, sf):
    obs = _obs(spark, sf)
    enc, dims = encode.ordinal_encode(obs, ["site"], 80)
    dec = encode.decode_map(dims["site"])
    out = clean.decode_codes(enc.select("row_id", "site_code"), "site_code", dec, "code", "category", "site_label")
    return out.select("row_id", "site_code", "site_label")


RS = ["acct", "qty", "price", "weight"]


@query("robust_scale", with_rec("SELECT row_id, " + ", ".join(
    f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 6) AS {c}" for c in RS)
    + " FROM rec, (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in RS) + " FROM rec) s"))
def q_robust_scale(spark, sf):
    return round_doubles(encode.robust_scale(_obs(spark, sf).select("row_id", *RS), RS))


@query("standard_scale", with_rec("SELECT row_id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in RS)
    + " FROM rec, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in RS) + " FROM rec) s"))
def q_standard_scale(spark, sf):
    return round_doubles(encode.standard_scale(_obs(spark, sf).select("row_id", *RS), RS))


@query("encode_scale_frame", with_rec("SELECT row_id, d_seg.code AS seg, d_prio.code AS prio, " + ", ".join(
    f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 6) AS {c}"
    for c in ["acct", "qty"])
    + " FROM rec LEFT JOIN d_seg ON rec.seg = d_seg.v LEFT JOIN d_prio ON rec.prio = d_prio.v, (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in ["acct", "qty"]) + " FROM rec) s",
    _ord_cte("seg", min_freq=1), _ord_cte("prio", min_freq=1)))
def q_encode_scale_frame(spark, sf):
    df = _obs(spark, sf).select("row_id", "seg", "prio", "acct", "qty")
    return round_doubles(encode.encode_scale_frame(df, ["seg", "prio"], ["acct", "qty"]))



