"""Queries: profiling aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import profile, score
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec
from sparkfill.session import read_table

NUM = ["acct", "n_items", "qty", "price", "site", "weight"]


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("missing_ratio", with_rec("""SELECT "column", round(missing_pct, 6) AS missing_pct FROM (
  SELECT 'area' AS "column", avg((area IS NULL)::int) * 100 AS missing_pct FROM rec
  UNION ALL SELECT 'flag', avg((flag IS NULL)::int) * 100 FROM rec
  UNION ALL SELECT 'weight', avg((weight IS NULL)::int) * 100 FROM rec
  UNION ALL SELECT 'acct', avg((acct IS NULL)::int) * 100 FROM rec) x WHERE missing_pct > 0"""))
def q_missing_ratio(spark, sf):
    return round_doubles(profile.missing_ratio(_obs(spark, sf), ["area", "flag", "weight", "acct"]))


@query("group_missingness", with_rec("""SELECT district, count(*) AS n, count(*) - count(flag) AS n_missing,
  round(avg((flag IS NULL)::int), 6) AS missing_share FROM rec GROUP BY district"""))
def q_group_missingness(spark, sf):
    return round_doubles(profile.group_missingness(_obs(spark, sf), "district", "flag"))


def _summary_sql():
    parts = [f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
      round(min({c})::double, 6) AS "min", round(max({c})::double, 6) AS "max",
      round(quantile_cont({c}, 0.5), 6) AS median FROM rec""" for c in NUM]
    return with_rec("\nUNION ALL ".join(parts))


@query("numeric_summary", _summary_sql())
def q_numeric_summary(spark, sf):
    return round_doubles(profile.numeric_summary(_obs(spark, sf), NUM))


@query("value_counts", with_rec("""SELECT seg AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM rec WHERE seg IS NOT NULL GROUP BY seg HAVING count(*) > 100"""))
def q_value_counts(spark, sf):
    return round_doubles(profile.value_counts(_obs(spark, sf), "seg", min_count=100))


@query("group_mean_share", with_rec("""SELECT seg, round(avg(weight), 6) AS mean, count(weight) AS n,
  round(count(weight) / (SELECT count(weight) FROM rec WHERE seg IS NOT NULL)::double, 6) AS share
  FROM rec WHERE seg IS NOT NULL GROUP BY seg"""))
def q_group_mean_share(spark, sf):
    return round_doubles(profile.group_mean_share(_obs(spark, sf), "seg", "weight"))


@query("contingency", with_rec("SELECT seg, prio, count(*) AS n FROM rec GROUP BY seg, prio"))
def q_contingency(spark, sf):
    return profile.contingency(_obs(spark, sf), "seg", "prio")


CORR = ["qty", "price", "weight", "acct"]


def _corr_sql():
    parts = []
    for a in CORR:
        for b in CORR:
            r = "max(1.0)" if a == b else f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({r}, 6) AS r FROM cc")
    return with_rec("\nUNION ALL ".join(parts),
                    f"cc AS (SELECT {', '.join(CORR)} FROM rec WHERE {' AND '.join(c + ' IS NOT NULL' for c in CORR)})")


@query("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return round_doubles(profile.corr_matrix(_obs(spark, sf), CORR))


@query("group_quantiles", with_rec("""SELECT seg, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std,
  round(min(weight), 6) AS "min", round(max(weight), 6) AS "max",
  round(quantile_cont(weight, 0.1), 6) AS p10, round(quantile_cont(weight, 0.25), 6) AS p25,
  round(quantile_cont(weight, 0.75), 6) AS p75, round(quantile_cont(weight, 0.9), 6) AS p90
  FROM rec WHERE seg IS NOT NULL AND weight IS NOT NULL GROUP BY seg"""))
def q_group_quantiles(spark, sf):
    return round_doubles(profile.group_quantiles(_obs(spark, sf), "seg", "weight"))


_EDGES = """e AS (SELECT quantile_cont(weight, 0.0) e0, quantile_cont(weight, 1/3) e1,
   quantile_cont(weight, 2/3) e2, quantile_cont(weight, 1.0) e3 FROM rec),
wb AS (SELECT rec.*, CASE WHEN weight IS NULL OR weight < e0 OR weight > e3 THEN NULL
   WHEN weight <= e1 THEN concat(cast(round(e0, 2) AS varchar), ' to ', cast(round(e1, 2) AS varchar))
   WHEN weight <= e2 THEN concat(cast(round(e1, 2) AS varchar), ' to ', cast(round(e2, 2) AS varchar))
   ELSE concat(cast(round(e2, 2) AS varchar), ' to ', cast(round(e3, 2) AS varchar)) END AS bin FROM rec, e)"""


@query("quantile_bins", with_rec("SELECT row_id, bin FROM wb", _EDGES))
def q_quantile_bins(spark, sf):
    return profile.quantile_bins(_obs(spark, sf), "weight", 3).select("row_id", "bin")


@query("bin_category_share", with_rec("""SELECT bin, seg, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY bin), 6) AS share
  FROM wb WHERE bin IS NOT NULL AND seg IS NOT NULL GROUP BY bin, seg""", _EDGES))
def q_bin_category_share(spark, sf):
    b = profile.quantile_bins(_obs(spark, sf), "weight", 3)
    return round_doubles(profile.bin_category_share(b, "bin", "seg"))


@query("conditional_share", with_rec("""SELECT seg, flag, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY seg), 6) AS share
  FROM rec WHERE seg IS NOT NULL AND flag IS NOT NULL GROUP BY seg, flag"""))
def q_conditional_share(spark, sf):
    return round_doubles(profile.conditional_share(_obs(spark, sf), "flag", "seg"))


@query("corr_and_ols", with_rec("""SELECT round(corr(qty, weight), 6) AS r, round(regr_slope(weight, qty), 4) AS slope,
  round(regr_intercept(weight, qty), 4) AS intercept, regr_count(weight, qty) AS n,
  round(regr_intercept(weight, qty) + regr_slope(weight, qty) * 100, 4) AS pred_at_100 FROM rec"""))
def q_corr_and_ols(spark, sf):
    r = profile.corr_and_ols(_obs(spark, sf), "weight", "qty")
    r = r.withColumn("pred_at_100", F.col("intercept") + F.col("slope") * 100)
    return r.select(F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"),
                    F.round("intercept", 4).alias("intercept"), "n", F.round("pred_at_100", 4).alias("pred_at_100"))


@query("cluster_profile", with_rec("""SELECT district, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std
  FROM rec GROUP BY district"""))
def q_cluster_profile(spark, sf):
    return round_doubles(profile.cluster_profile(_obs(spark, sf), "district", "weight"))


@query("block_to_codes", with_rec("""SELECT district, array_to_string(list_sort(list_distinct(list(area))), ',') AS codes,
  count(DISTINCT area) AS n_codes FROM rec WHERE area IS NOT NULL GROUP BY district"""))
def q_block_to_codes(spark, sf):
    b = profile.block_to_codes(_obs(spark, sf), "district", "area")
    return b.select("district", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"),
                    F.col("n_codes").cast("bigint").alias("n_codes"))


@query("distinct_codes", with_rec("SELECT DISTINCT cast(area AS int) AS area FROM rec WHERE area IS NOT NULL"))
def q_distinct_codes(spark, sf):
    return profile.distinct_codes(_obs(spark, sf), "area")


_SEG_MODE = """m AS (SELECT seg, min_by(flag, (-n, flag)) AS pred FROM
   (SELECT seg, flag, count(*) AS n FROM rec WHERE flag IS NOT NULL GROUP BY seg, flag) GROUP BY seg),
h AS (SELECT rec.row_id, rec.true_flag, m.pred FROM rec JOIN m USING (seg) WHERE rec.flag IS NULL)"""


def _seg_mode_hidden(spark, sf):
    rec = records(spark, sf)
    obs = rec.where(F.col("flag").isNotNull())
    cnt = obs.groupBy("seg", "flag").agg(F.count(F.lit(1)).alias("n"))
    m = cnt.groupBy("seg").agg(F.min_by("flag", F.struct((-F.col("n")).alias("n"), F.col("flag"))).alias("pred"))
    return rec.where(F.col("flag").isNull()).join(m, "seg").select("row_id", "true_flag", "pred")


@query("score_class", with_rec("""SELECT round(sum(tp) / sum(ntrue), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  sum(ntrue) AS n FROM (
  SELECT cls, tp, npred, ntrue,
    CASE WHEN (CASE WHEN npred > 0 THEN tp / npred ELSE 0 END) + (CASE WHEN ntrue > 0 THEN tp / ntrue ELSE 0 END) > 0
      THEN 2 * (CASE WHEN npred > 0 THEN tp / npred ELSE 0 END) * (CASE WHEN ntrue > 0 THEN tp / ntrue ELSE 0 END)
        / ((CASE WHEN npred > 0 THEN tp / npred ELSE 0 END) + (CASE WHEN ntrue > 0 THEN tp / ntrue ELSE 0 END))
      ELSE 0 END AS f1
  FROM (SELECT c.cls, coalesce(sum(CASE WHEN true_flag = pred AND true_flag = c.cls THEN 1 END), 0)::double AS tp,
          sum(CASE WHEN pred = c.cls THEN 1 ELSE 0 END)::double AS npred,
          sum(CASE WHEN true_flag = c.cls THEN 1 ELSE 0 END)::double AS ntrue
        FROM h, (SELECT true_flag AS cls FROM h UNION SELECT pred FROM h) c GROUP BY c.cls) x) y""", _SEG_MODE))
def q_score_class(spark, sf):
    return round_doubles(score.score_class(_seg_mode_hidden(spark, sf), "true_flag", "pred"))


@query("agreement_wilson", with_rec("""SELECT round(p, 6) AS rate, n,
  round((p + z*z/(2*n)) / (1 + z*z/n) - (z / (1 + z*z/n)) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) AS low,
  round((p + z*z/(2*n)) / (1 + z*z/n) + (z / (1 + z*z/n)) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) AS high
  FROM (SELECT avg((true_flag = pred)::int::double) AS p, count(*) AS n, 1.959963984540054 AS z FROM h) s""", _SEG_MODE))
def q_agreement_wilson(spark, sf):
    h = _seg_mode_hidden(spark, sf).withColumn("match", (F.col("true_flag") == F.col("pred")).cast("int"))
    return round_doubles(score.wilson_interval(h, "match"))


@query("pick_best_model", with_rec("""SELECT min_by(strategy, (mean_score, strategy)) AS best_model,
  round(min(mean_score), 6) AS best_score FROM (
  SELECT strategy, avg(mae) AS mean_score FROM (
    SELECT strategy, district, avg(abs(p - true_weight)) AS mae FROM (
      SELECT 'mean' AS strategy, district, s.m AS p, true_weight FROM rec, s WHERE weight IS NULL
      UNION ALL SELECT 'median', district, s.med, true_weight FROM rec, s WHERE weight IS NULL
      UNION ALL SELECT 'ols_qty', district, s.a + s.b * qty, true_weight FROM rec, s WHERE weight IS NULL) x
    GROUP BY strategy, district) y GROUP BY strategy) z""",
    """s AS (SELECT avg(weight) m, quantile_cont(weight, 0.5) med, regr_slope(weight, qty) b,
      regr_intercept(weight, qty) a FROM rec)"""))
def q_pick_best_model(spark, sf):
    from sparkfill.operators.impute import simple
    rec = records(spark, sf)
    obs = missing_view(rec)
    mean = simple.fill_values(obs, ["weight"], "mean")["weight"]
    med = simple.fill_values(obs, ["weight"], "median")["weight"]
    line = obs.agg(F.regr_slope("weight", "qty").alias("b"), F.regr_intercept("weight", "qty").alias("a")).first()
    hidden = rec.where(F.col("weight").isNull()).select(
        "district", "true_weight", F.lit(mean).alias("mean"), F.lit(med).alias("median"),
        (F.lit(line["a"]) + F.lit(line["b"]) * F.col("qty")).alias("ols_qty"))
    long = hidden.unpivot(["district", "true_weight"], ["mean", "median", "ols_qty"], "strategy", "p")
    per_set = long.groupBy("strategy", "district").agg(F.avg(F.abs(F.col("p") - F.col("true_weight"))).alias("mae"))
    best = score.pick_best(per_set, "strategy", "mae", lower_is_better=True)
    return round_doubles(best)


@query("histogram", with_rec("""SELECT bin, round(mn + bin * w, 6) AS lo, round(mn + (bin + 1) * w, 6) AS hi, n,
  round(mean, 6) AS mean, round(std, 6) AS std FROM (
  SELECT least(floor((weight - mn) / w)::int, 29) AS bin, count(*) AS n, mn, w, mean, std
  FROM rec, (SELECT min(weight) mn, (max(weight) - min(weight)) / 30 w, avg(weight) mean, stddev_samp(weight) std FROM rec) s
  WHERE weight IS NOT NULL GROUP BY 1, mn, w, mean, std) x"""))
def q_histogram(spark, sf):
    return round_doubles(profile.histogram(_obs(spark, sf), "weight", 30))


@query("describe_text", with_rec("""
SELECT 'weight' AS "column", printf('%s: mean %.2f, std %.2f, min %.2f, max %.2f, median %.2f', 'weight',
  avg(weight), stddev_samp(weight), min(weight), max(weight), quantile_cont(weight, 0.5)) AS text FROM rec
UNION ALL
SELECT 'seg', 'seg: ' || string_agg(printf('%s: %.2f%%', seg, 100.0 * n / tot), ', ' ORDER BY seg) FROM
  (SELECT seg, count(*) AS n, sum(count(*)) OVER () AS tot FROM rec WHERE seg IS NOT NULL GROUP BY seg) x"""))
def q_describe_text(spark, sf):
    obs = _obs(spark, sf)
    return profile.describe_continuous(obs, "weight").unionByName(profile.describe_categorical(obs, "seg"))


_WORDS = r"[^ \t\r\f\x0B]+"


@query("token_cost", f"""SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN len(regexp_extract_all(text, '{_WORDS}')) ELSE 0 END) AS tokens_in,
  sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '{_WORDS}')) ELSE 0 END) AS tokens_out,
  round(sum(CASE WHEN role <> 'assistant' THEN len(regexp_extract_all(text, '{_WORDS}')) ELSE 0 END) / 1000.0 * 0.01
      + sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '{_WORDS}')) ELSE 0 END) / 1000.0 * 0.03, 6) AS cost
  FROM conversations GROUP BY conv_id""")
def q_token_cost(spark, sf):
    conv = read_table(spark, sf, "conversations")
    n = F.size(F.regexp_extract_all(F.col("text"), F.lit(_WORDS), 0))
    per = conv.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).cast("bigint").alias("tokens_in"),
        F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).cast("bigint").alias("tokens_out"))
    return per.withColumn("cost", F.round(profile.token_cost("tokens_in", "tokens_out"), 6))


@query("word_count", f"""SELECT lang, count(*) AS n_lines, sum(len(regexp_extract_all(line, '{_WORDS}')))::bigint AS n_words
  FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) x
  WHERE regexp_matches(line, '[A-Za-z]{{3}}') GROUP BY lang""")
def q_word_count(spark, sf):
    docs = read_table(spark, sf, "documents").select("lang", "text")
    return profile.word_count(docs, "text", ["lang"])


_EMB = """el AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::double AS v FROM embeddings),
cent AS (SELECT label, pos, avg(v) AS c, count(*) AS n FROM el GROUP BY label, pos),
pairs AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dist
          FROM cent a JOIN cent b ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label)"""


@query("centroid_pairs", "WITH " + _EMB + "\nSELECT i, j, round(dist, 6) AS dist FROM pairs")
def q_centroid_pairs(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    cent = profile.centroids(profile.vector_long(emb, "vec_id", "embedding", "label"), "label")
    return round_doubles(profile.centroid_pairs(cent, "label"))


@query("davies_bouldin", "WITH " + _EMB + """,
d AS (SELECT el.vec_id, el.label, sqrt(sum((el.v - cent.c) * (el.v - cent.c))) AS d FROM el JOIN cent USING (label, pos)
      GROUP BY el.vec_id, el.label),
s AS (SELECT label, avg(d) AS s FROM d GROUP BY label)
SELECT round(avg(m), 6) AS davies_bouldin FROM (
  SELECT i, max((si.s + sj.s) / dist) AS m FROM pairs JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i) x""")
def q_davies_bouldin(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return round_doubles(profile.davies_bouldin(emb, "vec_id", "embedding", "label"))


@query("calinski_harabasz", "WITH " + _EMB + """,
g AS (SELECT pos, avg(v) AS g FROM el GROUP BY pos),
w AS (SELECT sum((el.v - cent.c) * (el.v - cent.c)) AS W FROM el JOIN cent USING (label, pos)),
b AS (SELECT sum(n * (c - g) * (c - g)) AS B FROM cent JOIN g USING (pos)),
nk AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
SELECT round(CASE WHEN k > 1 THEN (B / (k - 1)) / (W / (n - k)) END, 6) AS calinski_harabasz FROM w, b, nk""")
def q_calinski_harabasz(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return round_doubles(profile.calinski_harabasz(emb, "vec_id", "embedding", "label"))
