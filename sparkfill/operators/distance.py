"""Distance operators: nearest group (C4/I17, S9), Gower k-NN (C6, S8), k-distance (E3),
and the neighbour fill inside clusters (I9). The k-NN joins themselves are in ``operators/knn.py``.

Nearest group never compares a record with the members of a group one by one.
The mean Gower distance from a record to a group splits by column:

* categorical column: 1 - share of the record's value among the group's members;
* numeric column: mean |x - y| over members / range, where
  sum|x - y| = (2c - n) x - 2s + S  with c, s = count and sum of members with y <= x,
  n, S the group totals, and range = max(max_g, x) - min(min_g, x).

So each (group, column) is reduced once to its distinct values with counts and
sums; records look up ``c`` and ``s`` as-of their value (exact prefix sums in
approximate-quantile buckets, so a hot group or column is split over tasks).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfill.operators import knn, regions
from sparkfill.session import broadcast_checked, cut_lineage, side_by_side

N_BUCKETS = 64
#: Terms of records beside their candidate groups that one task sums, about.
GROUP_ROWS = 500_000


# --------------------------------------------------------------------------- as-of prefix sums

def asof_prefix(points: DataFrame, queries: DataFrame, group_cols: Sequence[str], value_col: str,
                weight_cols: Sequence[str], n_buckets: int = N_BUCKETS) -> DataFrame:
    """For each query row (group, value), sums of each weight over points with value <= query value.

    ``points``: (group..., value, weights...) with unique (group, value).
    ``queries``: (group..., value) distinct. Returns queries + ``cum_<w>`` columns."""
    g = list(group_cols)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = points.groupBy(*g).agg(
        F.percentile_approx(F.col(value_col).cast("double"), probs, 1000).alias("__splits"))
    splits = broadcast_checked(splits)
    bucket = F.size(F.filter("__splits", lambda s: s < F.col(value_col).cast("double")))
    p = points.join(splits, g).withColumn("__b", bucket).drop("__splits")
    q = queries.join(splits, g).withColumn("__b", bucket).drop("__splits")
    # every bucket that holds a point or a query gets an offset (a query bucket may hold no point)
    tot = (p.select(*g, "__b", *[F.col(w).alias(f"__t_{w}") for w in weight_cols])
            .unionByName(q.select(*g, "__b", *[F.lit(0).cast(dict(points.dtypes)[w]).alias(f"__t_{w}")
                                               for w in weight_cols]))
            .groupBy(*g, "__b").agg(*[F.sum(f"__t_{w}").alias(f"__t_{w}") for w in weight_cols]))
    wo = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, "__b", *[F.coalesce(F.sum(f"__t_{w}").over(wo), F.lit(0)).alias(f"__o_{w}")
                                   for w in weight_cols])
    u = (p.select(*g, "__b", value_col, F.lit(0).alias("__isq"), *[F.col(w) for w in weight_cols])
          .unionByName(q.select(*g, "__b", value_col, F.lit(1).alias("__isq"),
                                *[F.lit(0).cast(dict(points.dtypes)[w]).alias(w) for w in weight_cols])))
    w = (Window.partitionBy(*g, "__b").orderBy(value_col, "__isq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.select(*g, "__b", value_col, "__isq", *[F.sum(c).over(w).alias(f"__r_{c}") for c in weight_cols])
    u = u.where(F.col("__isq") == 1).join(broadcast_checked(offs), g + ["__b"], "left")
    return u.select(*g, value_col, *[(F.coalesce(F.col(f"__o_{c}"), F.lit(0)) + F.col(f"__r_{c}")).alias(f"cum_{c}")
                                     for c in weight_cols])


# --------------------------------------------------------------------------- nearest group

def _long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], kind: str) -> DataFrame:
    if not cols:
        return None
    cast = "double" if kind == "num" else "string"
    return (df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
              .unpivot(list(ids), list(cols), "column", "x").where(F.col("x").isNotNull()))


def nearest_group_scores(df: DataFrame, key: str, block: str, code: str,
                         numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(key, cand, score): mean Gower distance from each record with an unknown code to each
    candidate code group of its block (all codes when the block is null or unknown)."""
    known = df.where(F.col(code).isNotNull())
    missing = df.where(F.col(code).isNull())
    numeric = [c for c in numeric if c != code]
    categorical = [c for c in categorical if c != code]

    # candidate groups per record: the codes of its block; a record whose block is null or
    # unknown belongs to the root of the hierarchy, whose codes are all known codes
    root = "__all__"
    block_codes = known.select(F.col(block).cast("string").alias("__blk"), F.col(code).alias("cand")).distinct()
    hierarchy = block_codes.unionByName(block_codes.select(F.lit(root).alias("__blk"), "cand").distinct())
    blocks = block_codes.select("__blk").distinct().withColumn("__known_block", F.lit(True))
    m = (missing.select(key, F.col(block).cast("string").alias("__blk"))
                .join(broadcast_checked(blocks), "__blk", "left")
                .withColumn("__blk", F.when(F.col("__known_block"), F.col("__blk")).otherwise(F.lit(root))))
    pairs = m.join(broadcast_checked(hierarchy), "__blk").select(key, "cand")

    # every record beside each of its candidates; a task gets about GROUP_ROWS terms of its records at most
    both = missing.select(key, *dict.fromkeys(c for c in [*numeric, *categorical] if c != key)).join(pairs, key)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() * (len(numeric) + len(categorical)) // GROUP_ROWS))

    terms = []
    if numeric:
        mem = _long(known.withColumnRenamed(code, "cand"), ["cand"], numeric, "num")
        dist = mem.groupBy("cand", "column", "x").agg(F.count(F.lit(1)).alias("cnt"),
                                                     F.sum("x").alias("sx"))
        gstat = mem.groupBy("cand", "column").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("S"),
                                                 F.min("x").alias("mn"), F.max("x").alias("mx"))
        rq = _long(both, [key, "cand"], numeric, "num")               # (key, cand, column, x)
        qpts = rq.select("cand", "column", "x").distinct()
        t = asof_prefix(dist, qpts, ["cand", "column"], "x", ["cnt", "sx"]).join(broadcast_checked(cut_lineage(gstat)), ["cand", "column"])
        x, c, s, n, S = F.col("x"), F.col("cum_cnt"), F.col("cum_sx"), F.col("n"), F.col("S")
        mean_abs = ((2 * c - n) * x - 2 * s + S) / n
        rng = F.greatest(F.col("mx"), x) - F.least(F.col("mn"), x)
        t = t.select("cand", "column", "x", F.when(rng > 0, mean_abs / rng).otherwise(F.lit(0.0)).alias("term"))
        terms.append(rq.join(t, ["cand", "column", "x"]).select(key, "cand", "term"))
    if categorical:
        mem = _long(known.withColumnRenamed(code, "cand"), ["cand"], categorical, "cat")
        share = cut_lineage(mem.groupBy("cand", "column", "x").agg(F.count(F.lit(1)).alias("cnt")))
        tot = share.groupBy("cand", "column").agg(F.sum("cnt").alias("n"))
        rq = _long(both, [key, "cand"], categorical, "cat")
        t = rq.join(broadcast_checked(tot), ["cand", "column"]).join(broadcast_checked(share), ["cand", "column", "x"], "left") \
            .select(key, "cand", (1 - F.coalesce(F.col("cnt"), F.lit(0)) / F.col("n")).alias("term"))
        terms.append(t)
    allt = terms[0] if len(terms) == 1 else terms[0].unionByName(terms[1])
    return allt.repartition(tasks, key).groupBy(key, "cand").agg(F.avg("term").alias("score"))


def nearest_group(df: DataFrame, key: str, block: str, code: str, numeric: Sequence[str],
                  categorical: Sequence[str]) -> DataFrame:
    """(key, best_code, best_score): least mean Gower distance, ties to the lowest code (C4)."""
    sc = nearest_group_scores(df, key, block, code, numeric, categorical)
    return sc.groupBy(key).agg(
        F.min_by("cand", F.struct("score", "cand")).alias("best_code"),
        F.min("score").alias("best_score"))


def impute_nearest_code(df: DataFrame, key: str, block: str, code: str, numeric: Sequence[str],
                        categorical: Sequence[str]) -> DataFrame:
    """Fill every unknown code with its nearest group."""
    best = nearest_group(df, key, block, code, numeric, categorical)
    t = dict(df.dtypes)[code]
    return (df.join(best.select(key, "best_code"), key, "left")
              .withColumn(code, F.coalesce(F.col(code), F.col("best_code").cast(t))).drop("best_code"))


# --------------------------------------------------------------------------- Gower k-NN

#: Rows of a block of the k-NN fill at most, about, and blocks of the like rows of a cluster, if these are no larger for it.
KNN_BLOCK, KNN_CELLS = 2048, 500
#: Candidates of a block, and of a cell of like records, about.
RECORD_BLOCK, RECORD_CELL = 512, 128
#: Cells of the records of one kind at most, and null patterns of the queries that are looked at kind by kind.
MOST_CELLS, PATTERNS = 1000, 16


def gower_neighbours(df: DataFrame, queries: DataFrame, key: str, target: str, numeric: Sequence[str],
                     categorical: Sequence[str], k: int = 10, scope_cols: Sequence[str] | None = None,
                     same: str | None = None, exclude: Sequence[str] = (), far: bool = False, counts: dict | None = None,
                     per_query: str | None = None) -> DataFrame:
    """Per query record its k nearest (or, with ``far``, k farthest) candidates: ``key, cand, value, dist, rn``.

    Scope columns = columns (of ``scope_cols`` or all features) where the query record is
    non-null, minus ``exclude``; candidates = rows complete on the scope with a target.
    Range per column is taken over candidates and the record. ``same`` restricts candidates
    to the record's own value of that column (e.g. its cluster). Ties go to the lowest key.
    ``per_query``: one row a query instead, ``key, n, total`` (``"sums"``: number and sum of the values), with
    the list ``cands``, nearest first (``"cands"``).

    Exact for any number of queries and candidates. They meet in regions of like records (``operators/regions.py``),
    or, with very many kinds of records or values that are not finite, in blocks (``operators/knn.py``): near ones are
    sought among records of the query's own categories first, and among the others only by queries that may find nearer
    ones there; far ones among the candidates on the outside in some direction (queries beyond the candidates'
    range: among all). Queries without a candidate have no row."""
    feats = [c for c in (scope_cols or list(numeric) + list(categorical)) if c not in exclude and c != target]
    num = [c for c in feats if c in numeric]
    # bit i: feats[i] is null
    nulls = sum((F.shiftleft(F.col(c).isNull().cast("bigint"), i) for i, c in enumerate(feats)), F.lit(0).cast("bigint"))
    cl = F.col(same).cast("string") if same else F.lit("")
    typed = [F.col(c).cast("double" if c in num else "string").alias(c) for c in feats]
    t = dict(df.dtypes)
    value_type = t[target] if t[target] in knn._ARROW else "double"
    q = queries.select(cl.alias("cl"), F.col(key).cast(t[key]).alias("id"), nulls.alias("nulls"), *typed).where(F.col("cl").isNotNull())
    cand = df.where(F.col(target).isNotNull()).select(cl.alias("cl"), F.col(key).alias("id"), nulls.alias("nulls"),
                                                      F.col(target).cast(value_type).alias("value"), *typed).where(F.col("cl").isNotNull())
    known = regions.described(q, cand, feats, num, k, t[key], value_type)
    if known is not None:
        layout, mine, theirs = known
        if counts is not None:
            counts["possible"] = sum(int(n) * int(layout.n[layout.meets(a)[0]].sum()) for a, n in enumerate(layout.asked_n))
        kept = {None: (True, True, True), "cands": (True, False, False), "sums": (False, False, False)}[per_query]
        found = (regions.farthest if far else regions.nearest)(layout, mine, theirs, kept, counts)
        if found is not None:
            if per_query:
                return found.select(F.col("id").alias(key), "n", "total", *(["cands"] if per_query == "cands" else []))
            found = found.select("id", F.posexplode(F.arrays_zip("cands", "vals", "vs")).alias("place", "one"))
            v = F.col("one.vs")
            dist = F.when(v == 0, F.lit(0.0)).otherwise(-v) if far else v
            return found.select(F.col("id").alias(key), F.col("one.cands").alias("cand"), F.col("one.vals").alias("value"), dist.alias("dist"), (F.col("place") + 1).alias("rn"))
    # ranges per null pattern of the queries (and value of ``same``): few distinct keys, each over its candidates
    full = (1 << len(feats)) - 1
    pats = cut_lineage(q.select(F.col("cl").alias("p_cl"), F.col("nulls").alias("p_nulls")).distinct())
    pats, some = broadcast_checked(pats), pats.limit(PATTERNS + 1).count()
    ok = (F.col("cl") == F.col("p_cl")) & (F.col("nulls").bitwiseAND(F.lit(full) - F.col("p_nulls")) == 0)
    met = cand.join(pats, ok)
    if num:
        rng = cut_lineage(met.groupBy("p_cl", "p_nulls").agg(*[F.min(c).alias("p_mn_" + c) for c in num], *[F.max(c).alias("p_mx_" + c) for c in num]))
        met = cand.join(broadcast_checked(rng), ok)
        own = rng.withColumnsRenamed({"p_cl": "cl", "p_nulls": "nulls"} | {f"p_{e}_{c}": f"{e}_{c}" for c in num for e in ("mn", "mx")})
        q = q.join(broadcast_checked(own), ["cl", "nulls"])  # a pattern without candidates has no range
    cat = [c for c in feats if c not in num]
    q = q.withColumn("kind", knn.kind(F.col("cl"), F.col("nulls"), feats, cat))
    met = met.withColumn("kind", knn.kind(F.col("p_cl"), F.col("p_nulls"), feats, cat))
    no_range = {f"{e}_{c}": F.lit(None).cast("double") for c in num for e in ("mn", "mx")}
    cand = cand.withColumns(no_range)
    space = knn.gower(feats, num, far)
    if counts is not None:
        pairs = q.groupBy(F.col("cl").alias("p_cl"), F.col("nulls").alias("p_nulls")).agg(F.count(F.lit(1)).alias("n")).join(cand.select("cl", "nulls"), ok)
        counts["possible"], counts["compared"] = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, 0

    def join(queries, candidates, like):
        size = candidates.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("cl", "nulls", *like)).alias("cells")).first()
        each = size.n / max(size.cells, 1)
        cell = max(RECORD_CELL, each / MOST_CELLS)  # descriptions of blocks meet in pairs, so they are not too many
        cuts = knn.bin_cuts(candidates, num, each / cell)
        part: dict | None = {} if counts is not None else None
        found = knn.knn_join(knn.record_cells(queries, cuts, like), knn.record_cells(candidates, cuts, like), space, k, t[key], value_type,
                             int(max(RECORD_BLOCK, 4 * cell)), part)
        if counts is not None:
            counts["compared"] += part["compared"]
        return found

    by_kind = bool(cat or far) and bool(num) and some <= PATTERNS
    if by_kind and far:
        sizes = met.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("kind").alias("kinds")).first()
        by_kind = len(num) <= knn.DIRECTIONS and sizes.kinds <= knn.KINDS and q.select("kind").distinct().limit(knn.KINDS + 1).count() <= knn.KINDS
    if by_kind:
        q = cut_lineage(q)
    if not by_kind:
        found = join(q, cand, [] if far and num else cat)
    elif far:
        within = [F.col(c).isNull() | ((F.col(c) >= F.col("mn_" + c)) & (F.col(c) <= F.col("mx_" + c)) & (F.abs(F.col("mx_" + c) - F.col("mn_" + c)) < float("inf"))) for c in num]
        inside = functools.reduce(lambda a, b: a & b, within)
        kinds = q.where(inside).select(F.col("cl").alias("p_cl"), F.col("nulls").alias("p_nulls"), "kind", *cat).distinct()
        few = cut_lineage(knn.farthest_candidates(kinds, met.drop("cl"), feats, num, k, -(-sizes.n // knn.SHARE_ROWS)))
        few = few.withColumn("cl", F.col("kind")).select("cl", "id", "nulls", "value", *feats).withColumns(no_range)
        found = join(q.where(inside).withColumn("cl", F.col("kind")), few, [])
        outside = cut_lineage(q.where(~inside))
        if outside.limit(1).count():
            found = knn.k_best(found.unionByName(join(outside, cand, [])).drop("rn"), k)
    else:
        # another value of a categorical column costs a whole share, so mostly records of the query's own kind are nearer
        own = met.withColumn("cl", F.col("kind")).select("cl", "id", "nulls", "value", *feats).withColumns(no_range)
        found = cut_lineage(join(q.withColumn("cl", F.col("kind")), own, []))
        used = q.groupBy("id").agg(F.max(F.bit_count(F.lit(full) - F.col("nulls"))).alias("used")).withColumnRenamed("id", "__id")
        sure = found.where(F.col("rn") == k).join(used, F.col("id").eqNullSafe(F.col("__id"))).where(F.col("v") * F.col("used") < 1 - knn.CLOSE).select("__id")
        unsure = cut_lineage(q.join(sure, F.col("id").eqNullSafe(F.col("__id")), "left_anti"))
        if unsure.limit(1).count():
            rest = join(unsure, cand, cat)
            found = found.join(sure, F.col("id").eqNullSafe(F.col("__id")), "left_semi").unionByName(rest)
    dist = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(-F.col("v")) if far else F.col("v")
    found = found.select(F.col("id").alias(key), "cand", "value", dist.alias("dist"), "rn")
    if not per_query:
        return found
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rn", "cand"))), lambda x: x["cand"])
    return found.groupBy(key).agg(F.count("value").cast("int").alias("n"), F.sum("value").alias("total"), *([ranked.alias("cands")] if per_query == "cands" else []))


def gower_knn(df: DataFrame, queries: DataFrame, key: str, target: str, numeric: Sequence[str],
              categorical: Sequence[str], k: int = 10, **options) -> DataFrame:
    """Per query record: sum of ``target`` over its k nearest and k farthest candidates (:func:`gower_neighbours`)."""
    near, far = side_by_side(df.sparkSession, [functools.partial(gower_neighbours, df, queries, key, target, numeric, categorical, k, far=f, per_query="sums", **options)
                                               for f in (False, True)])
    both = near.withColumn("far", F.lit(False)).unionByName(far.withColumn("far", F.lit(True)))
    one = {(c, f): F.sum(F.when(F.col("far") == f, F.col(c))) for c in ("total", "n") for f in (False, True)}
    return both.groupBy(key).agg(one["total", False].alias("sum_near"), F.coalesce(one["n", False], F.lit(0)).alias("n_near"),
                                 one["total", True].alias("sum_far"), F.coalesce(one["n", True], F.lit(0)).alias("n_far"))


# --------------------------------------------------------------------------- k-NN fill inside clusters

def knn_fill(df: DataFrame, key: str, cluster: str | None, target: str, features: Sequence[str], k: int = 5,
             categorical: bool = False, only: Column | None = None) -> DataFrame:
    """Fill ``target`` from the k nearest donors of the same cluster, or of the table without ``cluster``
    (nan-Euclidean over shared columns, scaled by d / present): their mean, or the mode of a
    categorical target; no donor -> column mean, or mode (S18 knn). Rows without a cluster are
    a cluster of their own; every row stays. ``only`` restricts which rows are filled.

    Exact for clusters of any size (``operators/knn.py``): donors and rows are cut into blocks of like records of
    about ``KNN_BLOCK`` at most, and only blocks meet that the ranges of their columns leave within reach."""
    wanted = F.col(target).isNull() & (only if only is not None else F.lit(True))
    label = F.coalesce(F.concat(F.lit("="), F.col(cluster).cast("string")), F.lit("")) if cluster else F.lit("")
    typed = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features]
    rows = df.select(F.col(key).cast("long").alias("id"), label.alias("cl"), F.col(target).isNotNull().alias("is_donor"), wanted.alias("wanted"), *typed)
    rows = rows.where(F.col("is_donor") | F.col("wanted"))
    t = dict(df.dtypes)[target] if categorical else "double"
    asking = cut_lineage(rows.where("wanted").select("cl").distinct())
    if not asking.limit(1).count():
        return df.withColumn(target, F.col(target).cast(t))
    rows = rows.join(broadcast_checked(asking), "cl", "left_semi")  # the donors of other clusters are nobody's
    nulls = sum((F.shiftleft(F.col(c).isNull().cast("bigint"), i) for i, c in enumerate(features)), F.lit(0).cast("bigint"))
    rows = cut_lineage(rows.withColumn("nulls", nulls))
    donors, queries = rows.where("is_donor").withColumn("value", F.lit(0.0)), rows.where(~F.col("is_donor"))
    size = donors.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("cl", "nulls")).alias("parts")).first()
    each = size.n / max(size.parts, 1)
    block = int(min(KNN_BLOCK, max(RECORD_BLOCK, each / KNN_CELLS)))
    cuts = knn.even_cuts(donors, features, each / block) if features else {}
    queries, donors = (knn.record_cells(side.drop("is_donor", "wanted"), cuts, []) for side in (queries, donors))
    near = knn.knn_join(queries, donors, knn.shared_columns(features), k, "bigint", size=block)
    top = near.select("id", F.col("cand").alias("donor"))
    top = top.join(df.select(F.col(key).alias("donor"), F.col(target).alias("__value")), "donor")
    if categorical:
        best = F.min_by("__value", F.struct((-F.col("n")).alias("n"), F.col("__value")))
        fill = top.groupBy("id", "__value").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(best.alias("__fill"))
        rest = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("__value")).agg(F.count(F.lit(1)).alias("n")).agg(best.alias("m")).first()["m"]
    else:
        fill = top.groupBy("id").agg(F.avg("__value").alias("__fill"))
        rest = df.agg(F.avg(target).alias("m")).first()["m"]
    out = df.join(fill.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left")
    value = F.when(wanted, F.coalesce(F.col("__fill"), F.lit(rest)).cast(t)).otherwise(F.col(target).cast(t))
    return out.withColumn(target, value).drop("__fill", "__id")


# --------------------------------------------------------------------------- k-distance

def k_distance(df: DataFrame, key: str, vec: str, k: int, block: str, queries: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """Euclidean distance from each row (or each of ``queries``) to its k-th nearest other row of the same block.

    Exact for blocks of any size (``operators/knn.py``). Null vectors, vectors with a null or non-finite
    component and vectors of another length have no distance; a row with fewer than k others has no result."""
    t = dict(df.dtypes)[key]
    cols = [F.col(block).cast("string").alias("cl"), F.col(key).alias("id"), F.col(vec).alias("vec")]
    q, c = ((side if side is not None else df).select(*cols).where(F.col("cl").isNotNull()) for side in (queries, df))
    q, c = knn.vectors_with_pivots(q, c.withColumn("value", F.lit(0.0)))
    near = knn.knn_join(q, c, knn.euclidean(), k, t, counts=counts)
    return near.where(F.col("rn") == k).select(F.col("id").alias(key), F.col("v").alias("k_dist"))
