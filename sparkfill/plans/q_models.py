"""Queries: model-based operators.

Fitted models are not reproducible by SQL; their deterministic inner parts have
their own exact queries (``pca_covariance``, ``elasticnet_gram``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import cluster, encode, select, stack
from sparkfill.operators.impute import chained, equations, lowrank, registry, strategies
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, truth_view, with_rec
from sparkfill.session import cut_lineage, written

PC = ["acct", "qty", "price", "site"]
NUMF = ["district", "acct", "n_items", "qty", "price", "site"]
KF = ["acct", "n_items", "qty", "price", "site"]


def _obs(spark, sf):
    return missing_view(records(spark, sf))


@query("pca_reduce")
def q_pca_reduce(spark, sf):
    obs = _obs(spark, sf).select("row_id", *PC)
    out, _, _ = cluster.pca_reduce(encode.robust_scale(obs, PC), "row_id", PC, 0.95)
    return round_doubles(out)


# covariances of the PCA inputs in thousands (keeps magnitudes comparable for the 6-decimal check)
@query("pca_covariance", with_rec("SELECT a, b, round(cov, 6) AS cov FROM (\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a} / 1000, {b} / 1000) AS cov FROM rec" for i, a in enumerate(PC) for b in PC[i:])
    + ") x"))
def q_pca_covariance(spark, sf):
    obs = _obs(spark, sf).select(*[(F.col(c) / 1000).alias(c) for c in PC])
    return round_doubles(cluster.covariance_entries(obs, PC))


def _scaled(spark, sf):
    obs = _obs(spark, sf).select("row_id", *PC)
    return encode.robust_scale(obs, PC)


@query("kmeans_assign")
def q_kmeans_assign(spark, sf):
    labels, _ = cluster.kmeans_assign(_scaled(spark, sf), "row_id", PC, 5)
    return labels


@query("kmeans_inertia_curve")
def q_kmeans_inertia_curve(spark, sf):
    return round_doubles(cluster.kmeans_inertia_curve(_scaled(spark, sf), "row_id", PC))


@query("select_elasticnet")
def q_select_elasticnet(spark, sf):
    sel, rank = select.select_elasticnet(_obs(spark, sf), "row_id", "weight", KF)
    return round_doubles(rank.withColumn("selected", F.col("column").isin(sel)))


EN = ["qty", "price", "acct"]


def _gram_sql():
    cols = EN + ["weight"]
    scaled = ", ".join(f"({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END AS {c}"
                       for c in cols)
    qs = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in cols)
    terms = [("n", "count(*)::double")] + [(f"s_{c}", f"sum({c})") for c in cols]
    terms += [(f"p_{a}_{b}", f"sum({a} * {b})") for i, a in enumerate(cols) for b in cols[i:]]
    body = "\nUNION ALL ".join(f"SELECT fold, '{t}' AS term, round({e}, 4) AS value FROM f GROUP BY fold" for t, e in terms)
    return with_rec(body, "cc AS (SELECT row_id, " + ", ".join(cols) + " FROM rec WHERE "
                    + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")",
                    f"sc AS (SELECT row_id, {scaled} FROM cc, (SELECT {qs} FROM cc) q)",
                    """rk AS (SELECT sc.*, row_number() OVER (ORDER BY row_id) - 1 AS r, count(*) OVER () AS n FROM sc)""",
                    """f AS (SELECT rk.*, CAST((r >= (n // 5 + CASE WHEN 0 < n % 5 THEN 1 ELSE 0 END))::int
       + (r >= 2 * (n // 5) + least(n % 5, 2))::int + (r >= 3 * (n // 5) + least(n % 5, 3))::int
       + (r >= 4 * (n // 5) + least(n % 5, 4))::int AS INT) AS fold FROM rk)""")


@query("elasticnet_gram", _gram_sql())
def q_elasticnet_gram(spark, sf):
    cols = EN + ["weight"]
    d = _obs(spark, sf).select("row_id", *cols).na.drop()
    d = select.contiguous_folds(encode.robust_scale(d, cols), "row_id", 5)
    aggs = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(c).alias(f"s_{c}") for c in cols]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    g = d.groupBy("fold").agg(*aggs)
    names = [c for c in g.columns if c != "fold"]
    return round_doubles(g.unpivot(["fold"], names, "term", "value"), 4)


@query("select_rfe")
def q_select_rfe(spark, sf):
    _, ranks = select.select_rfe(_obs(spark, sf), "row_id", "weight", KF)
    return ranks


@query("rfe_curve")
def q_rfe_curve(spark, sf):
    """Out-of-fold score of every subset size."""
    return round_doubles(select.rfe_cv(_obs(spark, sf), "row_id", "weight", KF)[2])


@query("grid_search")
def q_grid_search(spark, sf):
    _, table = select.grid_search(_obs(spark, sf), "row_id", "flag", KF, categorical=True)
    return round_doubles(table)


@query("best_folds")
def q_best_folds(spark, sf):
    _, table = select.best_folds(_obs(spark, sf), "row_id", "weight", KF)
    return round_doubles(table)


@query("select_features")
def q_select_features(spark, sf):
    sel, rank = select.select_features(_obs(spark, sf), "row_id", "weight", KF, "LASSO", mnar=True)
    return round_doubles(rank.withColumn("selected", F.col("column").isin(sel)))


@query("cluster_records")
def q_cluster_records(spark, sf):
    res = cluster.cluster_records(_obs(spark, sf), "row_id", "weight", NUMF + ["weight"], method="reduced",
                                  selected=["qty", "price"])
    return res["labels"]


def _stack_train(spark, sf):
    from sparkfill.operators import sampling
    rec = records(spark, sf)
    obs = missing_view(rec)
    labels = obs.select("row_id", F.col("district").alias("cluster"))
    masked, hidden = sampling.mask_random(obs, "weight", "sim0", "row_id")
    masked = written(masked, "masked")  # the three strategies read it several times each
    strat = strategies.impute_three_ways(masked, "row_id", "weight", KF, labels, method="ice", selected=["price"])
    lab = strat.join(hidden, "row_id").join(truth_view(rec).select("row_id", F.col("weight").alias("truth")), "row_id")
    return cut_lineage(lab)  # read by every pass of the fit, and again by what is asked of the model


FEATS3 = [f"weight{s}" for s in stack.STRATEGY_SUFFIXES]


@query("fit_stacker")
def q_fit_stacker(spark, sf):
    lab = _stack_train(spark, sf)
    m = stack.fit_stacker(lab, FEATS3, "truth", categorical=False)
    return round_doubles(stack.predict(m, lab, FEATS3).select("row_id", "truth", "pred"))


@query("model_importances")
def q_model_importances(spark, sf):
    lab = _stack_train(spark, sf)
    m = stack.fit_stacker(lab, FEATS3, "truth", categorical=False)
    return round_doubles(stack.model_importances(m, FEATS3, spark))


def _ensemble(spark, sf):
    rec = records(spark, sf)
    obs = missing_view(rec).select("row_id", "district", "weight", *[c for c in KF])
    labels = obs.select("row_id", F.col("district").alias("cluster"))
    return stack.impute_ensemble(obs, truth_view(rec), "row_id", "weight", KF, labels, categorical=False, method="ice", selected=["price"])


@query("model_by_testset")
def q_model_by_testset(spark, sf):
    return round_doubles(_ensemble(spark, sf)["scores"])


@query("impute_ensemble")
def q_impute_ensemble(spark, sf):
    return round_doubles(_ensemble(spark, sf)["filled"].select("row_id", "weight"))


CH = ["district", "acct", "n_items", "qty", "price", "site", "seg", "prio", "area", "flag", "weight"]
CODES = ("district", "area", "flag", "seg", "prio")


def _chained(spark, sf, fill, **options):
    """``fill`` over the record view: its results, fills first."""
    return fill(_obs(spark, sf).select("row_id", *CH), CH, "row_id", CODES, **options)


def _filled(out):
    return round_doubles(out.select("row_id", "area", "flag", "weight"))


@query("impute_ice")
def q_impute_ice(spark, sf):
    return _filled(_chained(spark, sf, equations.chained_equations)[0])


@query("impute_ice_rounds")
def q_impute_ice_rounds(spark, sf):
    """How far the missing cells of each column moved in each round, and whether the rounds settled."""
    return round_doubles(_chained(spark, sf, equations.chained_equations)[1])


@query("impute_missforest")
def q_impute_missforest(spark, sf):
    return _filled(_chained(spark, sf, chained.missforest)[0])


@query("impute_hyper")
def q_impute_hyper(spark, sf):
    return _filled(_chained(spark, sf, chained.hyperimpute)[0])


@query("impute_hyper_races")
def q_impute_hyper_races(spark, sf):
    """Which model each column took in each round, and how its rivals scored."""
    return round_doubles(_chained(spark, sf, chained.hyperimpute, max_rounds=2)[2])


EMC = ["acct", "qty", "price", "site", "weight"]


@query("impute_em")
def q_impute_em(spark, sf):
    obs = _obs(spark, sf).select("row_id", *EMC)
    return round_doubles(registry.impute_table(obs, EMC, "EM").select("row_id", "weight"))


@query("impute_softimpute")
def q_impute_softimpute(spark, sf):
    obs = _obs(spark, sf).select("row_id", *EMC)
    return round_doubles(registry.impute_table(obs, EMC, "softimpute").select("row_id", "weight"))


@query("impute_lowrank_rounds")
def q_impute_lowrank_rounds(spark, sf):
    """Rounds and last changes of EM and SoftImpute."""
    obs = _obs(spark, sf).select("row_id", *EMC)
    em, soft = lowrank.em_fit(obs, EMC)[1], lowrank.softimpute_fit(obs, EMC)[1]
    return round_doubles(em.withColumn("method", F.lit("EM")).unionByName(soft.withColumn("method", F.lit("softimpute"))))


def elastic_net_ctes(xs, y):
    """DuckDB coordinate descent of the cross-validated elastic net on complete rows (S11), one sweep a step: ``en_sel`` has
    the weights w0, w1, ... of ``xs`` at the best penalty. Problem 5 are all rows, 0 to 4 those without that fold."""
    cols, ks = [*xs, y], range(len(xs))
    scaled = ", ".join(f"({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END AS z{i}" for i, c in enumerate(cols))
    qs = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in cols)
    t = len(xs)  # the place of y
    sums = ", ".join([f"sum(z{i}) AS s{i}" for i in range(t + 1)] + [f"sum(z{i} * z{j}) AS p{i}_{j}" for i in range(t + 1) for j in range(i, t + 1)])
    centred = ", ".join([f"s{i} / n AS m{i}" for i in range(t + 1)]
                        + [f"p{min(i, j)}_{max(i, j)} - s{i} * s{j} / n AS g{i}_{j}" for i in ks for j in range(t + 1)])
    steps, v = [], [f"w{j}" for j in ks]
    for j in ks:
        rho = f"(g{j}_{t} - ({' + '.join(f'g{j}_{i} * {v[i]}' for i in ks)}) + g{j}_{j} * w{j})"
        steps.append(f"""CASE WHEN g{j}_{j} = 0 THEN w{j} ELSE sign({rho}) * greatest(abs({rho}) / n - a * 0.5, 0) / (g{j}_{j} / n + a * 0.5) END AS v{j}""")
        v[j] = f"v{j}"
    most = f"greatest({', '.join(f'abs(v{j})' for j in ks)})"
    moved = f"greatest({', '.join(f'abs(v{j} - w{j})' for j in ks)})"
    b = f"(g.m{t} - ({' + '.join(f'g.m{j} * w{j}' for j in ks)}))"
    quad = " + ".join(f"w{i} * w{j} * p{min(i, j)}_{max(i, j)}" for i in ks for j in ks)
    sse = f"""p{t}_{t} - 2 * ({b} * o.s{t} + {' + '.join(f'w{j} * p{j}_{t}' for j in ks)})
      + o.n * {b} * {b} + 2 * {b} * ({' + '.join(f'w{j} * o.s{j}' for j in ks)}) + {quad}"""
    return [
        "en_c AS MATERIALIZED (SELECT row_id, " + ", ".join(cols) + " FROM rec WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")",
        f"en_z AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS r, count(*) OVER () AS n, {scaled} FROM en_c, (SELECT {qs} FROM en_c) q)",
        f"""en_f AS MATERIALIZED (SELECT CAST({' + '.join(f'(r >= {i} * (n // 5) + least(n % 5, {i}))::int' for i in range(1, 5))} AS INT) AS fold,
   count(*)::double AS n, {sums} FROM en_z GROUP BY ALL)""",
        f"""en_g AS MATERIALIZED (SELECT p, n, {centred} FROM (SELECT p, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in
            [f's{i}' for i in range(t + 1)] + [f'p{i}_{j}' for i in range(t + 1) for j in range(i, t + 1)])}
   FROM en_f JOIN (SELECT unnest(range(6)) AS p) ON fold <> p GROUP BY p))""",
        f"en_a AS MATERIALIZED (SELECT greatest({', '.join(f'abs(g{j}_{t})' for j in ks)}) / (n * 0.5) AS amax FROM en_g WHERE p = 5)",
        f"""en_w AS MATERIALIZED (WITH RECURSIVE sweep AS (
  SELECT p, 0 AS i, 0 AS it, false AS done, {', '.join(f'0.0::double AS w{j}' for j in ks)} FROM en_g
  UNION ALL SELECT p, i, it, {most} = 0 OR {moved} < 1e-4 * {most} OR it >= 1000, {', '.join(f'v{j}' for j in ks)}
  FROM (SELECT *, {', '.join(steps)} FROM (
    SELECT s.p, CASE WHEN done THEN i + 1 ELSE i END AS i, CASE WHEN done THEN 1 ELSE it + 1 END AS it, {', '.join(f'w{j}' for j in ks)},
      amax * pow(10.0, -3.0 * (CASE WHEN done THEN i + 1 ELSE i END) / 99) AS a, g.* EXCLUDE (p)
    FROM sweep s JOIN en_g g ON g.p = s.p, en_a WHERE CASE WHEN done THEN i + 1 ELSE i END < 100)))
  SELECT * FROM sweep WHERE done)""",
        f"""en_b AS (SELECT i FROM (SELECT i, sum(({sse}) / o.n) AS mse FROM en_w w JOIN en_g g ON g.p = w.p JOIN en_f o ON o.fold = w.p GROUP BY i)
   ORDER BY mse, i LIMIT 1)""",
        f"en_sel AS MATERIALIZED (SELECT {', '.join(f'w{j}' for j in ks)} FROM en_w JOIN en_b USING (i) WHERE p = 5)",
    ]


def _selected_sql(xs, y):
    """Least squares on the columns that the elastic net keeps, one column made orthogonal to those before it at a time."""
    out = elastic_net_ctes(xs, y)
    out.append(f"o0 AS (SELECT row_id, {y}, " + ", ".join(f"CASE WHEN w{j} <> 0 THEN {x} ELSE 0 END::double AS x{j}" for j, x in enumerate(xs)) + " FROM rec, en_sel)")

    def slope(of, j):
        return f"CASE WHEN var_pop(e{j}) > 0 THEN covar_pop({of}, e{j}) / var_pop(e{j}) ELSE 0 END"

    for k in range(len(xs)):
        earlier = "".join(f", {slope(f'x{k}', j)} AS b{j}" for j in range(k))
        out.append(f"""o{k + 1} AS MATERIALIZED (SELECT o.*, x{k} - m{''.join(f' - b{j} * e{j}' for j in range(k))} AS e{k}
   FROM o{k} o, (SELECT avg(x{k}) AS m{earlier} FROM o{k} WHERE {y} IS NOT NULL) f)""")
    last = f"o{len(xs)}"
    fits = "".join(f", {slope(y, j)} AS b{j}" for j in range(len(xs)))
    return with_rec(f"""SELECT row_id, round(coalesce({y}, greatest(lo, least(hi, m{''.join(f' + b{j} * e{j}' for j in range(len(xs)))}))), 6) AS {y}
  FROM {last}, (SELECT avg({y}) AS m, min({y}) AS lo, max({y}) AS hi{fits} FROM {last} WHERE {y} IS NOT NULL) f""", *out)


@query("impute_selected", _selected_sql(KF, "weight"))
def q_impute_selected(spark, sf):
    """Least squares on the features that the elastic net selects."""
    obs = _obs(spark, sf)
    sel, _ = select.select_elasticnet(obs, "row_id", "weight", KF)
    out = strategies.impute_selected(obs, "row_id", "weight", sel, "ice")
    return round_doubles(out.select("row_id", "weight"))


@query("tree_attribution")
def q_tree_attribution(spark, sf):
    from sparkfill.operators.attribution import tree_attribution
    lab = _stack_train(spark, sf)
    m = stack.fit_stacker(lab, FEATS3, "truth", categorical=False)
    return round_doubles(tree_attribution(m, lab, lab, FEATS3, "truth", "row_id"))


@query("impute_mice")
def q_impute_mice(spark, sf):
    """Five imputations with posterior draws and matched donors; numbers averaged, codes by vote."""
    return _filled(_chained(spark, sf, equations.chained_equations, draw=True, imputations=5, max_rounds=5)[0])
