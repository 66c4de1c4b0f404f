"""Queries: distance joins and neighbour fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfill.functions.scalars import round_doubles
from sparkfill.operators import distance
from sparkfill.plans.catalog import query
from sparkfill.plans.records import missing_view, records, with_rec
from sparkfill.session import read_table

NG_NUM = ["qty", "price", "site", "weight"]
NG_CAT = ["district", "seg", "flag"]


def _ng_sql(body):
    num_terms = [f"""CASE WHEN m.{c} IS NULL THEN NULL WHEN greatest(g.mx_{c}, m.{c}) - least(g.mn_{c}, m.{c}) > 0
        THEN avg(abs(m.{c} - k.{c})) / (greatest(g.mx_{c}, m.{c}) - least(g.mn_{c}, m.{c})) ELSE 0.0 END""" for c in NG_NUM]
    cat_terms = [f"""avg(CASE WHEN m.{c} IS NULL OR k.{c} IS NULL THEN NULL WHEN m.{c} = k.{c} THEN 0.0 ELSE 1.0 END)"""
                 for c in NG_CAT]
    terms = num_terms + cat_terms
    names = [f"t{i}" for i in range(len(terms))]
    sel = ",\n  ".join(f"{t} AS {n}" for t, n in zip(terms, names))
    grp = ", ".join(f"g.mn_{c}, g.mx_{c}, m.{c}" for c in NG_NUM) + ", " + ", ".join(f"m.{c}" for c in NG_CAT)
    score = "(" + " + ".join(f"coalesce({n}, 0)" for n in names) + ") / (" + \
        " + ".join(f"({n} IS NOT NULL)::int" for n in names) + ")"
    ctes = [
        "kn AS (SELECT * FROM rec WHERE area IS NOT NULL)",
        "mi AS (SELECT * FROM rec WHERE area IS NULL)",
        "bc AS (SELECT DISTINCT district, area AS cand FROM kn)",
        """cands AS (SELECT mi.row_id, bc.cand FROM mi JOIN bc ON mi.district = bc.district
           UNION ALL SELECT mi.row_id, a.cand FROM mi, (SELECT DISTINCT cand FROM bc) a
           WHERE mi.district IS NULL OR mi.district NOT IN (SELECT district FROM bc))""",
        "gs AS (SELECT area AS cand, " + ", ".join(f"min({c}) mn_{c}, max({c}) mx_{c}" for c in NG_NUM)
        + " FROM kn GROUP BY area)",
        f"""pr AS (SELECT m.row_id, c.cand, {sel}
  FROM cands c JOIN mi m ON m.row_id = c.row_id JOIN gs g ON g.cand = c.cand JOIN kn k ON k.area = c.cand
  GROUP BY m.row_id, c.cand, {grp})""",
        f"sc AS (SELECT row_id, cand, {score} AS score FROM pr)",
        "best AS (SELECT row_id, arg_min(cand, (score, cand)) AS best_code FROM sc GROUP BY row_id)",
    ]
    return with_rec(body, *ctes)


@query("nearest_group_join", _ng_sql("SELECT row_id, CAST(best_code AS INT) AS best_code FROM best"))
def q_nearest_group_join(spark, sf):
    obs = missing_view(records(spark, sf))
    best = distance.nearest_group(obs, "row_id", "district", "area", NG_NUM, NG_CAT)
    return best.select("row_id", F.col("best_code").cast("int").alias("best_code"))


@query("impute_nearest_code", _ng_sql(
    "SELECT rec.row_id, CAST(coalesce(rec.area, best.best_code) AS INT) AS area FROM rec LEFT JOIN best USING (row_id)"))
def q_impute_nearest_code(spark, sf):
    obs = missing_view(records(spark, sf))
    cols = ["row_id", "district", "area"] + [c for c in NG_NUM + NG_CAT if c != "district"]
    out = distance.impute_nearest_code(obs.select(*cols), "row_id", "district", "area", NG_NUM, NG_CAT)
    return out.select("row_id", F.col("area").cast("int").alias("area"))


KNN_NUM = ["acct", "n_items", "qty", "price", "site"]
KNN_CAT = ["district", "seg", "prio", "flag"]


def knn_sql_ctes(target, feats, numeric, same=None, name="pairs", query_where=None, k=10):
    """DuckDB brute force of the Gower k-NN queries (same arithmetic order as the Spark operator): every
    record without the target against all candidates. ``{name}`` has the sums, ``{name}_near`` the nearest ones."""
    total = "0.0"
    for c in feats:
        if c in numeric:
            r = f"(greatest(g.mx_{c}, q.{c}) - least(g.mn_{c}, q.{c}))"
            t = f"CASE WHEN {r} > 0 THEN abs(c.{c} - q.{c}) / {r} ELSE 0.0 END"
        else:
            t = f"CASE WHEN c.{c} = q.{c} THEN 0.0 ELSE 1.0 END"
        total = f"({total} + CASE WHEN q.{c} IS NOT NULL THEN {t} ELSE 0.0 END)"
    used = " + ".join(f"(q.{c} IS NOT NULL)::int" for c in feats)
    mask = " || ".join(f"CASE WHEN {{0}}.{c} IS NULL THEN '_' ELSE '1' END" for c in feats)
    cond = " AND ".join(f"(substr(g.m, {i + 1}, 1) = '_' OR c.{c} IS NOT NULL)" for i, c in enumerate(feats))
    own, of_own = (f", {same} AS cl", f" AND c.{same} = g.cl") if same else (", 0 AS cl", "")
    nums = [c for c in feats if c in numeric]
    ranges = ", ".join(f"min(c.{c}) AS mn_{c}, max(c.{c}) AS mx_{c}" for c in nums) or "0 AS none"
    return [
        f"{name}_q AS (SELECT *, {mask.format('rec')} AS m{own} FROM rec WHERE {query_where or f'{target} IS NULL'})",
        f"""{name}_g AS (SELECT g.m, g.cl, {ranges} FROM (SELECT DISTINCT m, cl FROM {name}_q) g
    JOIN rec c ON c.{target} IS NOT NULL AND {cond}{of_own} GROUP BY g.m, g.cl)""",
        f"""{name}_d AS (SELECT q.row_id AS query, c.row_id AS cand, c.{target} AS tv,
    CASE WHEN ({used}) > 0 THEN {total} / ({used}) ELSE 0.0 END AS dist
    FROM {name}_q q JOIN {name}_g g ON g.m = q.m AND g.cl = q.cl JOIN rec c ON c.{target} IS NOT NULL AND {cond}{of_own})""",
        f"""{name}_k AS (SELECT query AS row_id, arg_min({{'cand': cand, 'tv': tv, 'dist': dist}}, (dist, cand), {k}) AS near,
    arg_min(tv, (-dist, cand), {k}) AS far FROM {name}_d GROUP BY query)""",
        f"""{name} AS (SELECT row_id, list_sum(list_transform(near, lambda x: x.tv)) AS sum_near, len(near)::BIGINT AS n_near,
    list_sum(far) AS sum_far, len(far)::BIGINT AS n_far, near FROM {name}_k)""",
    ]


def _knn_sql():
    return with_rec("SELECT row_id, round(sum_near, 6) AS sum_near, n_near, round(sum_far, 6) AS sum_far, n_far FROM kn",
                    *knn_sql_ctes("weight", KNN_CAT + KNN_NUM, KNN_NUM, name="kn"))


@query("gower_knn_join", _knn_sql())
def q_gower_knn_join(spark, sf):
    """Every record without a weight against all that have one."""
    obs = missing_view(records(spark, sf))
    return round_doubles(distance.gower_knn(obs, obs.where(F.col("weight").isNull()), "row_id", "weight", KNN_NUM, KNN_CAT, k=10))


@query("k_distance", """WITH p AS (SELECT q.vec_id AS q, c.vec_id AS c, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1),
        lambda i: (q.embedding[i]::double - c.embedding[i]::double) * (q.embedding[i]::double - c.embedding[i]::double)))) AS dist
  FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id)
SELECT q AS vec_id, round(dist, 6) AS k_dist FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, c) = 5""")
def q_k_distance(spark, sf):
    """Every vector against all of its label."""
    return round_doubles(distance.k_distance(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 5, "label"))


KF = ["acct", "n_items", "qty", "price", "site"]


@query("impute_knn", with_rec(f"""SELECT r.row_id, round(CASE WHEN r.weight IS NULL
    THEN coalesce(f.fill, (SELECT avg(weight) FROM rec)) ELSE r.weight END, 6) AS weight
  FROM rc r LEFT JOIN f USING (row_id)""",
    "rc AS (SELECT *, concat_ws('|', district, seg, prio) AS cl FROM rec)",
    f"""pp AS (SELECT r.row_id, d.row_id AS donor, d.weight,
   sqrt(({' + '.join(f'(r.{c} - d.{c}) * (r.{c} - d.{c})' for c in KF)}) * ({len(KF)} / {len(KF)})) AS dist
   FROM rc r JOIN rc d ON d.cl = r.cl AND d.weight IS NOT NULL
   WHERE r.weight IS NULL)""",
    "f AS (SELECT row_id, avg(weight) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, donor) rn FROM pp) WHERE rn <= 5 GROUP BY row_id)"))
def q_impute_knn(spark, sf):
    obs = missing_view(records(spark, sf)).withColumn("cl", F.concat_ws("|", "district", "seg", "prio"))
    out = distance.knn_fill(obs, "row_id", "cl", "weight", KF, k=5)
    return round_doubles(out.select("row_id", "weight"))
