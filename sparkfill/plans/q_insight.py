"""Queries: insights, prompts, requests, scoring hook and answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from sparkfill.functions.hashing import sql_order_key
from sparkfill.functions.scalars import round_doubles
from sparkfill.functions.template import record_text
from sparkfill.operators import distance, insight, prompt, sampling
from sparkfill.operators.insight import (share_item_template, stat_item_template, tpl_category_by_bins,
                                         tpl_category_pair, tpl_numeric_by_category, tpl_numeric_pair)
from sparkfill.plans.catalog import query
from sparkfill.plans.q_distance import knn_sql_ctes
from sparkfill.plans.records import ROLES, missing_view, records, with_rec
from sparkfill.session import forgotten, shared_path, side_by_side, written
from sparkfill.sources import files

CONT = {"acct", "n_items", "qty", "price", "site", "weight"}
STATS_FILTER = "weight BETWEEN 400 AND 8000"


def _obs(spark, sf):
    return missing_view(records(spark, sf))


def _data(obs):
    return obs.where(F.col("weight").between(400, 8000))


# ---------------------------------------------------------------- SQL mirrors of the four analyses

def _bin_case(x, prefix=""):
    lab = lambda i, j: f"concat(cast(round({prefix}e{i}, 2) AS varchar), ' to ', cast(round({prefix}e{j}, 2) AS varchar))"
    idx = f"""CASE WHEN {x} IS NULL OR {x} < {prefix}e0 OR {x} > {prefix}e3 THEN NULL WHEN {x} <= {prefix}e1 THEN 0
      WHEN {x} <= {prefix}e2 THEN 1 ELSE 2 END"""
    label = f"""CASE WHEN {x} IS NULL OR {x} < {prefix}e0 OR {x} > {prefix}e3 THEN NULL WHEN {x} <= {prefix}e1 THEN {lab(0, 1)}
      WHEN {x} <= {prefix}e2 THEN {lab(1, 2)} ELSE {lab(2, 3)} END"""
    return idx, label


def _edges_sql(x, src):
    return (f"(SELECT quantile_cont({x}, 0.0) e0, quantile_cont({x}, 1/3) e1, quantile_cont({x}, 2/3) e2, "
            f"quantile_cont({x}, 1.0) e3 FROM {src})")


def sql_insight(a, b, tag):
    """CTEs producing ins_{tag}(row_id, insight) from views dat (stats data) and rec (records)."""
    ca, cb = a in CONT, b in CONT
    d = f"d_{tag} AS (SELECT {a}, {b} FROM dat WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    if ca and cb:
        return [d, f"""ins_{tag} AS (SELECT row_id, {tpl_numeric_pair(a, b).sql()} AS insight FROM (
  SELECT rec.row_id, rec.{a}, s.r, s.icpt + s.slope * rec.{a} AS pred FROM rec,
   (SELECT corr({a}, {b}) r, regr_slope({b}, {a}) slope, regr_intercept({b}, {a}) icpt FROM d_{tag}) s
  WHERE rec.{a} IS NOT NULL) x)"""]
    if not ca and not cb:
        return [d, f"""dist_{tag} AS (SELECT {a}, string_agg({share_item_template().sql()}, ', ' ORDER BY cat) AS dist_text FROM (
  SELECT {a}, {b} AS cat, count(*) / sum(count(*)) OVER (PARTITION BY {a}) AS p FROM d_{tag} GROUP BY {a}, {b}) GROUP BY {a})""",
                f"""ins_{tag} AS (SELECT row_id, {tpl_category_pair(a, b).sql()} AS insight FROM (
  SELECT rec.row_id, rec.{a}, dist_{tag}.dist_text FROM rec LEFT JOIN dist_{tag} USING ({a}) WHERE rec.{a} IS NOT NULL) x)"""]
    if ca:
        idx, label = _bin_case(a)
        ridx, _ = _bin_case(f"rec.{a}", "e.")
        return [d, f"""st_{tag} AS (SELECT string_agg({stat_item_template().sql()}, '; ' ORDER BY cat) AS stats_text FROM (
  SELECT {b} AS cat, avg({a}) mean, stddev_samp({a}) std, min({a})::double mn, max({a})::double mx,
    quantile_cont({a}, 0.1) p10, quantile_cont({a}, 0.25) p25, quantile_cont({a}, 0.75) p75, quantile_cont({a}, 0.9) p90
  FROM d_{tag} GROUP BY {b}))""",
                f"e_{tag} AS {_edges_sql(a, f'd_{tag}')}",
                f"""bins_{tag} AS (SELECT bi, bin, string_agg({share_item_template().sql()}, ', ' ORDER BY cat) AS bin_text FROM (
  SELECT bi, bin, cat, count(*) / sum(count(*)) OVER (PARTITION BY bi) AS p FROM (
    SELECT {idx} AS bi, {label} AS bin, {b} AS cat FROM d_{tag}, e_{tag}) WHERE bi IS NOT NULL GROUP BY bi, bin, cat)
  GROUP BY bi, bin)""",
                f"""ins_{tag} AS (SELECT row_id, {tpl_numeric_by_category(a, b).sql()} AS insight FROM (
  SELECT rec.row_id, bins_{tag}.bin, bins_{tag}.bin_text, st_{tag}.stats_text FROM rec CROSS JOIN e_{tag} e
    LEFT JOIN bins_{tag} ON bins_{tag}.bi = {ridx} CROSS JOIN st_{tag} WHERE rec.{a} IS NOT NULL) x)"""]
    idx, label = _bin_case(b)
    return [d, f"e_{tag} AS {_edges_sql(b, f'd_{tag}')}",
            f"db_{tag} AS (SELECT {a}, {idx} AS bi, {label} AS bin FROM d_{tag}, e_{tag})",
            f"lb_{tag} AS (SELECT bi, first(bin) AS bin, count(*) AS t FROM db_{tag} WHERE bi IS NOT NULL GROUP BY bi)",
            f"""sh_{tag} AS (SELECT {a}, string_agg(bin || ': ' || printf('%.2f', p), ', ' ORDER BY bi) AS share_text FROM (
  SELECT c.{a}, lb.bi, lb.bin, coalesce(n.n, 0) / lb.t AS p FROM (SELECT DISTINCT {a} FROM d_{tag}) c CROSS JOIN lb_{tag} lb
  LEFT JOIN (SELECT {a}, bi, count(*) AS n FROM db_{tag} WHERE bi IS NOT NULL GROUP BY {a}, bi) n
    ON n.{a} = c.{a} AND n.bi = lb.bi) GROUP BY {a})""",
            f"""ins_{tag} AS (SELECT row_id, {tpl_category_by_bins(a, b).sql()} AS insight FROM (
  SELECT rec.row_id, rec.{a}, sh_{tag}.share_text FROM rec LEFT JOIN sh_{tag} USING ({a}) WHERE rec.{a} IS NOT NULL) x)"""]


DAT = f"dat AS (SELECT * FROM rec WHERE {STATS_FILTER})"

# ---------------------------------------------------------------- K1, K2, K3

_K1_COLS = ["row_id", "district", "area", "seg", "prio", "acct", "n_items", "qty", "price", "site", "flag", "weight"]


@query("variable_dictionary", with_rec("SELECT \"column\", description, round(missing_pct, 6) AS missing_pct FROM (\n"
                                       + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{ROLES.descriptions[c]}' AS description, avg(({c} IS NULL)::int) * 100 AS missing_pct FROM rec"
    for c in _K1_COLS) + ") x"))
def q_variable_dictionary(spark, sf):
    return round_doubles(insight.variable_dictionary(_obs(spark, sf).select(*_K1_COLS), ROLES.descriptions))


K2_PAIRS = [("qty", "weight"), ("seg", "flag"), ("qty", "flag"), ("seg", "weight")]


def _k2_sql():
    ctes = [DAT]
    for i, (a, b) in enumerate(K2_PAIRS):
        ctes += sql_insight(a, b, f"p{i}")
    body = "\nUNION ALL ".join(f"SELECT row_id, '{a}' AS inductor, '{b}' AS target, insight FROM ins_p{i}"
                               for i, (a, b) in enumerate(K2_PAIRS))
    return with_rec(body, *ctes)


@query("pair_insight", _k2_sql())
def q_pair_insight(spark, sf):
    obs = _obs(spark, sf)
    data = _data(obs)
    out = None
    for a, b in K2_PAIRS:
        p = insight.pair_insight(data, obs, "row_id", a, b, CONT).select(
            "row_id", F.lit(a).alias("inductor"), F.lit(b).alias("target"), "insight")
        out = p if out is None else out.unionByName(p)
    return out


K3_VARS = ["qty", "seg", "price", "prio"]


def _k3_ctes(target, tagp="v"):
    ctes = [DAT]
    for i, v in enumerate(K3_VARS):
        ctes += sql_insight(v, target, f"{tagp}{i}")
    union = "\nUNION ALL ".join(f"SELECT row_id, {i} AS idx, insight FROM ins_{tagp}{i}" for i in range(len(K3_VARS)))
    ctes.append(f"""ri_{tagp} AS (SELECT row_id, count(*) AS n_insights, string_agg(insight, chr(10) ORDER BY idx) AS insights
  FROM ({union}) GROUP BY row_id)""")
    return ctes


@query("record_insights", with_rec("SELECT row_id, n_insights, insights FROM ri_v", *_k3_ctes("weight")))
def q_record_insights(spark, sf):
    obs = _obs(spark, sf)
    return insight.record_insights(_data(obs), obs, "row_id", "weight", K3_VARS, CONT)


# ---------------------------------------------------------------- shared pieces for prompts

FEATS_FULL = ["district", "seg", "prio", "acct", "n_items", "qty", "price", "site", "weight"]
FEATS_SEL = ["seg", "qty", "price", "weight"]
NUM = ["acct", "n_items", "qty", "price", "site", "weight"]
REC_COLS = ["district", "seg", "prio", "acct", "n_items", "qty", "price", "site", "weight"]
DICTIONARY = "; ".join(f"{c}: {ROLES.descriptions[c]}" for c in REC_COLS + ["flag"])
RECORD = record_text(REC_COLS, set(NUM))


NEIGHBOUR = record_text(FEATS_SEL + ["flag"], set(NUM))
_KEPT: dict = {}


def _kept(spark, sf, name, build):
    """A table that several queries share: written once per session and input folder into the shared folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _KEPT:
        path = shared_path(spark, name)
        build().write.parquet(path)
        forgotten(spark)  # its shuffles
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def _selected(spark, sf, obs):
    """Steps that give the nearest and the farthest records by the selected columns."""
    return [lambda n=n, far=far: _kept(spark, sf, n, lambda: _neighbours(obs, FEATS_SEL, far=far)) for n, far in (("near-selected", False), ("far-selected", True))]


def _without_flag(obs):
    return obs.where(F.col("flag").isNull())


def _neighbours(obs, feats, same=None, far=False):
    """For each record without a flag the sum of its neighbours' flags (``value``); the nearest by the selected columns are named too (``cands``)."""
    found = distance.gower_neighbours(obs, _without_flag(obs), "row_id", "flag", NUM, ["district", "seg", "prio"], k=10, scope_cols=feats,
                                      same=same, far=far, per_query="cands" if feats is FEATS_SEL and not far else "sums")
    return found.withColumnRenamed("total", "value")


def _neighbour_rows(near, obs):
    """The nearest records themselves, one line each, nearest first."""
    lines = near.select(F.col("row_id").alias("query"), F.posexplode("cands").alias("rn", "row_id")).join(obs, "row_id")
    lines = lines.select("query", F.struct("rn", NEIGHBOUR.spark().alias("line")).alias("l"))
    lines = lines.groupBy(F.col("query").alias("row_id")).agg(F.array_sort(F.collect_list("l")).alias("l"))  # k of a record
    return lines.select("row_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("neighbours"))


def _sums(near, far):
    both = near.select("row_id", F.col("value").alias("near"), F.lit(None).cast("bigint").alias("far")).unionByName(
        far.select("row_id", F.lit(None).cast("bigint").alias("near"), F.col("value").alias("far")))
    return both.groupBy("row_id").agg(F.sum("near").alias("sum_near"), F.sum("far").alias("sum_far"))


_NEIGHBOUR_SQL = f"""nr AS (SELECT query AS row_id, string_agg({NEIGHBOUR.sql('r.')}, chr(10) ORDER BY rn) AS neighbours
  FROM (SELECT row_id AS query, unnest(near).cand AS cand, unnest(range(1, len(near) + 1)) AS rn FROM nb) n
  JOIN rec r ON r.row_id = n.cand GROUP BY query)"""


@query("imputation_prompt", with_rec(
    f"""SELECT q.row_id, 13 AS n_turns, {prompt.dialogue_sql(prompt.imputation_turns('flag', RECORD, DICTIONARY, FEATS_SEL), 'q.')}
      AS dialogue FROM (SELECT r.*, ri_f.insights, nb.sum_near, nb.sum_far, nr.neighbours FROM rec r LEFT JOIN ri_f USING (row_id)
      LEFT JOIN nb USING (row_id) LEFT JOIN nr USING (row_id) WHERE r.flag IS NULL) q""",
    *_k3_ctes("flag", "f"), *knn_sql_ctes("flag", FEATS_SEL, NUM, name="nb"), _NEIGHBOUR_SQL))
def q_imputation_prompt(spark, sf):
    """The dialogue of every record without a flag."""
    obs = _obs(spark, sf)
    q = _without_flag(obs)
    near, far = side_by_side(spark, _selected(spark, sf, obs))
    ins = insight.record_insights(_data(obs), q, "row_id", "flag", K3_VARS, CONT)
    d = q.join(ins, "row_id", "left").join(_sums(near, far), "row_id", "left").join(_neighbour_rows(near, obs), "row_id", "left")
    msgs = prompt.messages(prompt.imputation_turns("flag", RECORD, DICTIONARY, FEATS_SEL))
    return d.select("row_id", F.size(msgs).alias("n_turns"), prompt.dialogue_text(msgs).alias("dialogue"))


# ---- three strategies for flag and the vote (K6)

_VOTE_CTES = [
    "gm AS (SELECT flag AS g FROM rec WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)",
    "sm AS (SELECT seg, min_by(flag, (-n, flag)) AS s FROM (SELECT seg, flag, count(*) n FROM rec WHERE flag IS NOT NULL GROUP BY ALL) GROUP BY seg)",
    "pm AS (SELECT prio, min_by(flag, (-n, flag)) AS p FROM (SELECT prio, flag, count(*) n FROM rec WHERE flag IS NOT NULL GROUP BY ALL) GROUP BY prio)",
    """vt AS (SELECT rec.row_id, gm.g + sm.s + pm.p AS votes, CASE WHEN gm.g + sm.s + pm.p >= 2 THEN 1 ELSE 0 END AS majority,
  CASE WHEN gm.g + sm.s + pm.p = 1 THEN 1 WHEN gm.g + sm.s + pm.p = 2 THEN 0 END AS minority
  FROM rec CROSS JOIN gm JOIN sm USING (seg) JOIN pm USING (prio) WHERE rec.flag IS NULL)""",
]


def _votes(obs):
    known = obs.where(F.col("flag").isNotNull())
    from sparkfill.operators.impute import simple
    g = simple.most_frequent(known, ["flag"])["flag"]

    def mode_by(col, name):
        c = known.groupBy(col, "flag").agg(F.count(F.lit(1)).alias("n"))
        return c.groupBy(col).agg(F.min_by("flag", F.struct((-F.col("n")).alias("n"), F.col("flag"))).alias(name))
    d = obs.where(F.col("flag").isNull()).join(mode_by("seg", "s"), "seg").join(mode_by("prio", "p"), "prio") \
        .withColumn("g", F.lit(g))
    votes, majority, minority = insight.minority_vote(["g", "s", "p"])
    return d.select("*", votes.alias("votes"), majority.alias("majority"), minority.alias("minority"))


@query("minority_vote", with_rec("SELECT row_id, votes, majority, minority FROM vt", *_VOTE_CTES))
def q_minority_vote(spark, sf):
    return _votes(_obs(spark, sf)).select("row_id", "votes", "majority", "minority")


# ---- indicators (K7) over three neighbour scopes

RULES = ["price < 150000", "weight < 3000", "qty < 100"]


def _scope_ctes():
    out = knn_sql_ctes("flag", FEATS_FULL, NUM, name="nf")
    out += knn_sql_ctes("flag", FEATS_SEL, NUM, name="ns")
    return out + knn_sql_ctes("flag", FEATS_FULL, NUM, same="district", name="nc")


_IND_SQL = f"""(SELECT qs.*, nf.sum_near AS near_full, nf.sum_far AS far_full, ns.sum_near AS near_selected,
   ns.sum_far AS far_selected, nc.sum_near AS near_cluster, nc.sum_far AS far_cluster,
   coalesce((price < 150000)::int, 0) + coalesce((weight < 3000)::int, 0) + coalesce((qty < 100)::int, 0)
   + coalesce(((nf.sum_near > nf.sum_far)::int + (ns.sum_near > ns.sum_far)::int + (nc.sum_near > nc.sum_far)::int >= 2)::int, 0)
     AS n_indicators
   FROM rec qs LEFT JOIN nf USING (row_id) LEFT JOIN ns USING (row_id) LEFT JOIN nc USING (row_id) WHERE qs.flag IS NULL)"""


def _scopes(obs, selected):
    """Sums over the neighbours of each scope, for every record without a flag."""
    out = _without_flag(obs).select("row_id")

    def scope(same, far):
        out = written(_neighbours(obs, FEATS_FULL, same, far), "scope")
        forgotten(obs.sparkSession)  # its shuffles
        return out

    steps = [lambda same=same, far=far: scope(same, far) for same in (None, "district") for far in (False, True)]
    near_full, far_full, near_cluster, far_cluster, near_selected, far_selected = side_by_side(obs.sparkSession, steps + selected)
    for name, near, far in (("full", near_full, far_full), ("selected", near_selected, far_selected), ("cluster", near_cluster, far_cluster)):
        out = out.join(_sums(near, far).withColumnsRenamed({"sum_near": f"near_{name}", "sum_far": f"far_{name}"}), "row_id", "left")
    return out


def _indicators(spark, sf):
    obs = _obs(spark, sf)
    d = _without_flag(obs).join(_kept(spark, sf, "scopes", lambda: _scopes(obs, _selected(spark, sf, obs))), "row_id")
    scopes = sum(((F.col(f"near_{s}") > F.col(f"far_{s}")).cast("int") for s in ("full", "selected", "cluster")),
                 F.lit(0))
    n, decision = insight.indicator_rule([F.col("price") < 150000, F.col("weight") < 3000, F.col("qty") < 100,
                                          scopes >= 2])
    return d.withColumn("n_indicators", n).withColumn("decision", decision)


@query("indicator_rule", with_rec(f"""SELECT row_id, n_indicators, (n_indicators >= 2)::int AS decision FROM {_IND_SQL} x""",
                                  *_scope_ctes()))
def q_indicator_rule(spark, sf):
    """Every record without a flag."""
    return _indicators(spark, sf).select("row_id", "n_indicators", "decision")


_DISPUTED_SQL = f"(SELECT i.*, vt.votes, vt.majority, vt.minority FROM {_IND_SQL} i JOIN vt USING (row_id) WHERE vt.minority IS NOT NULL)"


@query("correction_prompt", with_rec(
    f"""SELECT x.row_id, 9 AS n_turns, {prompt.dialogue_sql(prompt.correction_turns('flag', RECORD, DICTIONARY, RULES), 'x.')}
      AS dialogue FROM {_DISPUTED_SQL} x""", *_scope_ctes(), *_VOTE_CTES))
def q_correction_prompt(spark, sf):
    """The dialogue of every record on whose flag the strategies are split."""
    return _correction_prompts(spark, sf).select("row_id", "n_turns", "dialogue")


def _correction_prompts(spark, sf):
    d = _indicators(spark, sf).join(_votes(_obs(spark, sf)).select("row_id", "votes", "majority", "minority"), "row_id") \
        .where(F.col("minority").isNotNull())
    msgs = prompt.messages(prompt.correction_turns("flag", RECORD, DICTIONARY, RULES))
    return d.select("row_id", "votes", F.size(msgs).alias("n_turns"), prompt.dialogue_text(msgs).alias("dialogue"))


# ---- rationale prompts and requests

RAT = prompt.rationale_prompt("weight", RECORD)


@query("rationale_prompt", with_rec(f"""SELECT row_id, {RAT.sql('x.')} AS prompt FROM (
  SELECT rec.*, weight AS target_value, ri_v.insights FROM rec LEFT JOIN ri_v USING (row_id) WHERE weight IS NOT NULL) x""",
    *_k3_ctes("weight")))
def q_rationale_prompt(spark, sf):
    obs = _obs(spark, sf)
    ins = insight.record_insights(_data(obs), obs, "row_id", "weight", K3_VARS, CONT)
    d = obs.where(F.col("weight").isNotNull()).join(ins, "row_id", "left").withColumn("target_value", F.col("weight"))
    return d.select("row_id", RAT.spark().alias("prompt"))


N_REQUESTS = 200
MODEL = "chat-model"


def _strata_sql():
    return [
        """se AS (SELECT quantile_cont(weight, 0.2) e1, quantile_cont(weight, 0.4) e2, quantile_cont(weight, 0.6) e3,
  quantile_cont(weight, 0.8) e4 FROM rec)""",
        """sst AS (SELECT row_id, CASE WHEN weight <= e1 THEN 0 WHEN weight <= e2 THEN 1 WHEN weight <= e3 THEN 2
  WHEN weight <= e4 THEN 3 ELSE 4 END AS stratum FROM rec, se WHERE weight IS NOT NULL)""",
        f"""ssz AS (SELECT stratum, {N_REQUESTS}.0 * count(*) / sum(count(*)) OVER () AS raw FROM sst GROUP BY stratum)""",
        f"""sal AS (SELECT stratum, floor(raw)::bigint + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum)
   <= {N_REQUESTS} - (SELECT sum(floor(raw)) FROM ssz) THEN 1 ELSE 0 END AS quota FROM ssz)""",
        f"""smp AS (SELECT row_id FROM sst JOIN sal USING (stratum)
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {sql_order_key('cot', 'row_id')}, row_id) <= quota)""",
    ]


def _request_sql_json():
    system = "You explain values in tabular records."
    return (f"to_json({{'custom_id': 'weight-' || cast(x.row_id AS varchar), 'method': 'POST', "
            f"'url': '/v1/chat/completions', 'body': {{'model': '{MODEL}', 'messages': "
            f"[{{'role': 'system', 'content': '{system}'}}, {{'role': 'user', 'content': {RAT.sql('x.')}}}], "
            f"'max_tokens': 800}}}})")


def _requests(spark, sf):
    obs = _obs(spark, sf)
    known = obs.where(F.col("weight").isNotNull())
    from sparkfill.operators.profile import bin_index, quantile_edges
    edges = quantile_edges(known, "weight", q=5, fallback_equal_width=False)
    st = known.crossJoin(F.broadcast(edges)).withColumn("stratum", bin_index("weight", "edges")).drop("edges")
    smp = sampling.stratified_sample(st, "stratum", N_REQUESTS, "cot")
    ins = insight.record_insights(_data(obs), smp, "row_id", "weight", K3_VARS, CONT)
    d = smp.join(ins, "row_id", "left").withColumn("target_value", F.col("weight"))
    req = prompt.request_struct(F.concat(F.lit("weight-"), F.col("row_id").cast("string")), RAT.spark(), MODEL)
    return d.select("row_id", F.lit("weight").alias("target"), req.alias("request"))


@query("request_table", with_rec(f"""SELECT 'weight-' || cast(x.row_id AS varchar) AS custom_id, {_request_sql_json()} AS request
  FROM (SELECT rec.*, weight AS target_value, ri_v.insights FROM smp JOIN rec USING (row_id) LEFT JOIN ri_v USING (row_id)) x""",
    *_strata_sql(), *_k3_ctes("weight")))
def q_request_table(spark, sf):
    r = _requests(spark, sf)
    return r.select(F.col("request.custom_id").alias("custom_id"), F.to_json("request").alias("request"))


@query("sink_jsonl", with_rec("""SELECT 'weight-' || cast(row_id AS varchar) AS custom_id, 'weight' AS target,
  'chat-model' AS model, 2 AS n_messages FROM smp""", *_strata_sql()))
def q_sink_jsonl(spark, sf):
    r = _requests(spark, sf).select("target", "request.*")
    path = shared_path(spark, "requests")
    files.sink_jsonl(r, path, ["target"])
    back = spark.read.schema("custom_id string, body struct<model: string, messages: array<struct<role: string, "
                             "content: string>>>, target string").json(path)
    return back.select("custom_id", "target", F.col("body.model").alias("model"),
                       F.size("body.messages").alias("n_messages"))


# ---- scoring hook with a rule scorer, stored pairs, parsed answers

_RULE = re.compile(r"(\w+) < ([\d.]+)")
_SCOPE = re.compile(r"nearest (None|[\d.]+), farthest (None|[\d.]+)\. ")


def rule_scorer(pdf):
    """Deterministic stand-in for a model: reads the record, the rules and the neighbour counts out of
    the dialogue and follows what it says."""
    out = []
    for dialogue in pdf["dialogue"]:
        blocks = dialogue.split("\n\n")
        record = dict(f.split(": ", 1) for f in blocks[2].removeprefix("user: ").split(", "))
        n = sum(record[c] != "None" and float(record[c]) < float(v) for c, v in _RULE.findall(blocks[8]))
        scopes = [(a, b) for a, b in _SCOPE.findall(blocks[8]) if "None" not in (a, b)]
        n += sum(float(a) > float(b) for a, b in scopes) >= 2
        out.append(json.dumps({"suggested_value": str(int(n >= 2)), "reasoning": f"{n} of 4 indicators hold"}))
    return out


def _scored(spark, sf):
    """Every correction dialogue with its answer, the truth and the vote."""
    truth = records(spark, sf).select("row_id", F.col("true_flag").alias("truth"))
    d = _correction_prompts(spark, sf).withColumn("combined", (F.col("votes") >= 2).cast("int")).join(truth, "row_id")
    return prompt.score_prompts(d, rule_scorer, ["dialogue"], ["row_id", "truth", "combined"])


_SCORED_SQL = f"""(SELECT i.row_id, '{{"suggested_value": "' || CASE WHEN n_indicators >= 2 THEN '1' ELSE '0' END
   || '", "reasoning": "' || cast(n_indicators AS varchar) || ' of 4 indicators hold"}}' AS output,
   rec.true_flag AS truth, (i.votes >= 2)::int AS combined
   FROM {_DISPUTED_SQL} i JOIN rec USING (row_id))"""


@query("score_prompts", with_rec(f"SELECT row_id, truth, combined, output FROM {_SCORED_SQL} s",
                                 *_scope_ctes(), *_VOTE_CTES))
def q_score_prompts(spark, sf):
    return _scored(spark, sf)


@query("sample_pairs_sink", with_rec(f"SELECT row_id, output, truth, combined FROM {_SCORED_SQL} s",
                                     *_scope_ctes(), *_VOTE_CTES))
def q_sample_pairs_sink(spark, sf):
    s = _scored(spark, sf).select("row_id", "output", "truth", "combined")
    path = shared_path(spark, "answers")
    files.sink_table(s, path)
    return spark.read.parquet(path)


@query("parse_answers", with_rec(f"""SELECT row_id, json_extract_string(output, '$.suggested_value') AS value,
  json_extract_string(output, '$.reasoning') AS reasoning,
  json_extract_string(output, '$.suggested_value') IS NOT NULL AND json_extract_string(output, '$.reasoning') IS NOT NULL AS valid
  FROM {_SCORED_SQL} s""", *_scope_ctes(), *_VOTE_CTES))
def q_parse_answers(spark, sf):
    return prompt.parse_answers(_scored(spark, sf)).select("row_id", "value", "reasoning", "valid")
