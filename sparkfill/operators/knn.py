"""Exact k-NN joins that leave out what cannot matter.

Both sides are cut into blocks of like rows, and a block is described by a few numbers: the least and
largest distances of its members to some pivots (vectors), or the range of every column (records).
From two descriptions alone follows a bound on the distances between the members, by the triangle
inequality or column by column. Then

1. every query block meets the candidate blocks that promise most, until they hold ``k`` rows; the
   worst k-th value of its queries is the block's limit;
2. of all other candidate blocks, it meets those whose bound is within the limit.

Pairs of descriptions are one equality join; only blocks that meet are shuffled. A query block streams
through the candidates that it meets in pieces, keeping its ``k`` best, so a task's memory does
not depend on how many there are; a query block with very many is dealt to several tasks.

The result is exact. How much is left out is a matter of the data: where distances are nearly
equal, as in noise of many dimensions, no bound can leave out anything.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfill.session import broadcast_checked, cut_lineage, side_by_side

#: Rows of a block at most, about.
BLOCK = 2048
#: Candidates that a query block meets in one task, about.
PER_TASK = 200_000
#: Candidates that are compared at once.
PIECE = 4096
#: Shares of the candidate blocks' descriptions, where there are too many to broadcast.
SHARES = 64


#: Types that ids and values may have.
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "date": pa.date32()}


@dataclass
class Metric:
    """What a task needs. ``values(queries, candidates)``: a matrix of what is to be least, infinite where two
    don't meet. If it is approximate, ``slack`` is by how much for each query, and ``sure`` computes
    given pairs (rows, columns) plainly.
    """

    values: Callable[[pa.Table, pa.Table], np.ndarray]
    slack: Callable[[pa.Table, pa.Table], np.ndarray] | None = None
    sure: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None


@dataclass
class Space:
    """How rows are described and compared. ``about``: the aggregates that describe a block; ``least``: no
    value between two blocks is below it (columns of the query block are prefixed ``q_``, of the
    candidate block ``c_``); ``near`` breaks ties of it; ``meet``: which blocks may meet at all;
    ``payload``, ``extra``: columns that ``metric`` reads, the latter of queries alone.
    """

    about: list[Column]
    least: Column
    near: Column
    metric: Metric
    payload: list[str]
    meet: Column | None = None
    extra: list[str] = field(default_factory=list)


def with_blocks(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``rows`` (cl, cell, ord, id, ...) with ``blk``: rings of ``ord`` within a cell, of about ``size`` rows each.

    Rings are cut at approximate quantiles, and a ring that is still too large (equal values, very large
    cells) is dealt by a hash, so no cell is sorted or counted in one task.
    """
    size = size or BLOCK
    probs = [i / 64 for i in range(1, 64)]
    cells = rows.groupBy("cl", "cell").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("ord", probs, 1000).alias("__cuts"))
    cells = broadcast_checked(cut_lineage(cells.withColumnsRenamed({"cl": "__cl", "cell": "__cell"})))
    out = rows.join(cells, (F.col("cl") == F.col("__cl")) & (F.col("cell") == F.col("__cell")))
    place = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col("ord")))
    rings = F.least(F.ceil(F.col("__n") / size), F.lit(64))
    out = out.withColumn("ring", F.floor(place * rings / 64).cast("int")).drop("__n", "__cuts", "__cl", "__cell")
    shares = out.groupBy("cl", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__k"))
    shares = broadcast_checked(cut_lineage(shares.withColumnsRenamed({"cl": "__cl", "cell": "__cell", "ring": "__ring"})))
    out = out.join(shares, (F.col("cl") == F.col("__cl")) & (F.col("cell") == F.col("__cell")) & (F.col("ring") == F.col("__ring")))
    share = F.pmod(F.xxhash64("id"), F.col("__k"))
    return out.withColumn("blk", F.xxhash64("cell", "ring", share)).drop("__k", "__cl", "__cell", "__ring", "ring", "cell", "ord")


def _described(rows: DataFrame, space: Space, prefix: str) -> DataFrame:
    out = rows.groupBy("cl", "blk").agg(F.count(F.lit(1)).alias("n"), *space.about)
    return out.select(F.col("cl").alias(f"{prefix}cl"), *[F.col(c).alias(prefix + c) for c in out.columns if c != "cl"])


def _block_pairs(q: DataFrame, c: DataFrame, space: Space) -> DataFrame:
    """All pairs of descriptions of one ``cl`` that may meet, with ``least``; the candidates' side is broadcast if it is small, dealt otherwise."""
    small = broadcast_checked(c)
    if small is c:
        c = c.withColumn("share", F.pmod("c_blk", F.lit(SHARES)))
        q = q.withColumn("q_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        pairs = q.join(c, (F.col("q_cl") == F.col("c_cl")) & (F.col("q_share") == F.col("share")))
    else:
        pairs = q.join(small, F.col("q_cl") == F.col("c_cl"))
    if space.meet is not None:
        pairs = pairs.where(space.meet)
    return pairs.withColumn("least", space.least).withColumn("near", space.near)


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Pieces of sorted batches with one value of ``keys`` each; a key may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            col = batch.column(k)
            change |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for x in range(a, b, PIECE):
                part = pa.Table.from_batches([batch.slice(x, min(PIECE, b - x))])
                yield tuple(part.column(k)[0].as_py() for k in keys), part


class _Best:
    """The ``k`` least values of each query of a block, with their candidates; ties go to the least candidate."""

    def __init__(self, queries: pa.Table, metric: Metric, k: int):
        self.queries, self.metric, self.k = queries, metric, k
        n = queries.num_rows
        self.row, self.value = np.empty(0, np.int64), np.empty(0)
        self.kept: pa.Table | None = None  # of self.row's candidates, in step
        self.limit = np.full(n, np.inf)

    def add(self, candidates: pa.Table) -> None:
        values = self.metric.values(self.queries, candidates)
        limit = self.limit
        if self.metric.slack is not None:  # values are approximate: whatever may be within the limit is computed anew
            slack = self.metric.slack(self.queries, candidates)
            n = min(self.k, values.shape[1])
            limit = np.minimum(limit, np.partition(values, n - 1, axis=1)[:, n - 1] + 2 * slack if n == self.k else np.inf)
            r, c = np.nonzero((values <= (limit + 2 * slack)[:, None]) & np.isfinite(values))
            found = self.metric.sure(self.queries, candidates, r, c)
            keep = np.isfinite(found) & (found <= self.limit[r])
            r, c, found = r[keep], c[keep], found[keep]
        else:
            n = min(self.k, values.shape[1])
            kth = np.minimum(limit, np.partition(values, n - 1, axis=1)[:, n - 1] if n == self.k else np.inf)
            r, c = np.nonzero((values <= kth[:, None]) & np.isfinite(values))
            found = values[r, c]
        if not len(r):
            return
        new = candidates.select(["id", "value"]).take(pa.array(c))
        kept = new if self.kept is None else pa.concat_tables([self.kept, new])
        row, value = np.concatenate([self.row, r]), np.concatenate([self.value, found])
        _, by_id = np.unique(kept.column("id").to_numpy(), return_inverse=True)
        order = np.lexsort((by_id, value, row))
        row = row[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        order = order[best]
        self.row, self.value, self.kept = row[best], value[order], kept.take(pa.array(order))
        counts = np.bincount(self.row, minlength=len(self.limit))
        full = np.flatnonzero(counts >= self.k)
        self.limit[full] = self.value[np.cumsum(counts)[full] - 1]

    def result(self, key: tuple, schema: pa.Schema) -> pa.RecordBatch:
        n = len(self.row)
        kept = self.kept if n else None
        cols = [[key[0]] * n, [key[1]] * n, self.queries.column("id").take(pa.array(self.row)), kept.column("id") if n else [], kept.column("value") if n else [], self.value]
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _compare(metric: Metric, k: int, schema: pa.Schema):
    keys = ("cl", "blk", "task", "is_cand")

    def compare(batches):
        best, own, held = None, None, []
        for key, part in _runs(batches, keys):
            if key[:3] != own:
                if best is not None:
                    yield best.result(own, schema)
                best, own, held = None, key[:3], []
            if not key[3]:
                held.append(part)
                continue
            if not held and best is None:
                continue  # candidates alone
            if best is None:
                best = _Best(pa.concat_tables(held).combine_chunks(), metric, k)
            best.add(part)
        if best is not None:
            yield best.result(own, schema)

    return compare


def _met(q: DataFrame, c: DataFrame, pairs: DataFrame, space: Space, k: int, id_type: str, value_type: str) -> DataFrame:
    """The ``k`` least values of each query over the candidates of the blocks that its block meets (k for each task)."""
    w = Window.partitionBy("q_cl", "q_blk")
    pairs = pairs.select("q_cl", "q_blk", "c_blk", F.col("c_n").alias("n"))
    pairs = pairs.withColumn("tasks", F.ceil(F.sum("n").over(w) / PER_TASK).cast("int"))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("c_blk"), F.col("tasks")).cast("int"))
    need = pairs.select("q_cl", "q_blk", "task").distinct()
    cols = ["id", *space.payload, *space.extra]
    qs = q.join(need, (F.col("cl") == F.col("q_cl")) & (F.col("blk") == F.col("q_blk"))).select("cl", "blk", "task", F.lit(False).alias("is_cand"), *cols, F.lit(None).cast(value_type).alias("value"))
    p = pairs.select(F.col("q_cl"), F.col("q_blk"), F.col("c_blk"), "task")
    cs = c.join(p, (F.col("cl") == F.col("q_cl")) & (F.col("blk") == F.col("c_blk")))
    cs = cs.select("cl", F.col("q_blk").alias("blk"), "task", F.lit(True).alias("is_cand"), *[F.col(x) if x in c.columns else F.lit(None).cast(dict(q.dtypes)[x]).alias(x) for x in cols], "value")
    both = qs.unionByName(cs).repartition("cl", "blk", "task").sortWithinPartitions("cl", "blk", "task", "is_cand")
    ddl = f"cl string, blk long, id {id_type}, cand {id_type}, value {value_type}, v double"
    schema = pa.schema([("cl", pa.string()), ("blk", pa.int64()), ("id", _ARROW[id_type]), ("cand", _ARROW[id_type]), ("value", _ARROW[value_type]), ("v", pa.float64())])
    return both.mapInArrow(_compare(space.metric, k, schema), ddl)


def k_best(found: DataFrame, k: int, *by: str) -> DataFrame:
    # "<= k" lets Spark keep only k rows per query in each map task before the shuffle
    w = Window.partitionBy(*by, "id").orderBy("v", "cand")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def knn_join(queries: DataFrame, candidates: DataFrame, space: Space, k: int, id_type: str, value_type: str = "double",
             size: int | None = None, counts: dict | None = None) -> DataFrame:
    """``id, cand, value, v, rn``: the ``k`` least values ``v`` of each query, by rank.

    Both sides have ``cl, id, cell, ord`` and the space's payload, candidates also ``value``; only rows of
    one ``cl`` meet. ``counts``, if given, gets the row pairs that were compared and those that there are.
    """
    # approximate cuts may differ from run to run, so they are kept
    q, c = side_by_side(queries.sparkSession, [functools.partial(lambda side: cut_lineage(with_blocks(side, size)), side) for side in (queries, candidates)])
    about_q, about_c = _described(q, space, "q_"), cut_lineage(_described(c, space, "c_"))
    pairs = _block_pairs(about_q, about_c, space)
    order = Window.partitionBy("q_cl", "q_blk").orderBy("least", "near", "c_blk")
    before = F.coalesce(F.sum("c_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pairs.withColumn("first", before < k)
    first = cut_lineage(_met(q, c, ranked.where("first"), space, k, id_type, value_type))
    kth = k_best(first, k, "cl", "blk").groupBy("cl", "blk", "id").agg(F.max("v").alias("kth"), F.count(F.lit(1)).alias("m"))
    limits = kth.groupBy("cl", "blk").agg(F.max("kth").alias("limit"), F.min("m").alias("m"), F.count(F.lit(1)).alias("full"))
    joined = ranked.where(~F.col("first")).join(limits, (F.col("cl") == F.col("q_cl")) & (F.col("blk") == F.col("q_blk")), "left")
    open_ = joined.where(F.col("limit").isNull() | (F.col("m") < k) | (F.col("full") < F.col("q_n")) | (F.col("least") <= F.col("limit")))
    if counts is not None:
        work = F.coalesce(F.sum(F.col("q_n") * F.col("c_n")), F.lit(0)).alias("w")
        counts["possible"] = ranked.agg(work).first().w
        counts["compared"] = ranked.where("first").agg(work).first().w + open_.agg(work).first().w
    rest = _met(q, c, open_, space, k, id_type, value_type)
    return k_best(first.unionByName(rest), k).select("id", "cand", "value", "v", "rn")


# --------------------------------------------------------------------------- vectors

#: Pivots for vectors of one length, and lengths that have pivots.
PIVOTS, LENGTHS = 16, 32


def _stacked(table: pa.Table) -> np.ndarray:
    col = table.column("vec").combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _with_pivots(pivots: dict[int, np.ndarray]):
    def add(batches):
        for batch in batches:
            cell, order, all_ = [], [], []
            for v in batch.column("vec"):
                x = np.asarray(v.values)
                p = pivots.get(len(x))
                d = np.sqrt(((p - x) ** 2).sum(axis=1)) if p is not None else np.empty(0)
                cell.append(str(int(np.argmin(d))) if len(d) else "")
                order.append(float(d.min()) if len(d) else 0.0)
                all_.append(d)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(cell, pa.string()), pa.array(order, pa.float64()), pa.array(all_, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "cell", "ord", "pd"])

    return add


def vectors_with_pivots(*sides: DataFrame) -> list[DataFrame]:
    """``cl, id, vec`` (and more) of each side, with ``cell, ord, pd``: nearest pivot, distance to it, distances to all.

    Vectors with a null or non-finite component are left out. Pivots come from the last side: the vectors of
    least hash, for each of the commonest lengths. ``cl`` gets the length, as only equal lengths meet.
    """
    out = []
    for side in sides:
        vec = F.col("vec").cast("array<double>")
        side = side.withColumn("vec", vec).where(F.col("vec").isNotNull() & F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(1e150), F.lit(False))))
        out.append(side.withColumn("cl", F.concat_ws(":", F.size("vec").cast("string"), F.col("cl").cast("string"))))
    last = out[-1].withColumn("len", F.size("vec"))
    common = [r.len for r in last.groupBy("len").count().orderBy(F.desc("count"), "len").limit(LENGTHS).collect()]
    w = Window.partitionBy("len").orderBy(F.xxhash64("vec"), "vec")
    chosen = last.where(F.col("len").isin(common)).select("len", "vec").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= PIVOTS).collect()
    pivots = {n: np.array([r.vec for r in chosen if r.len == n], float) for n in common if n}
    return [s.mapInArrow(_with_pivots(pivots), ", ".join(f"`{n}` {t}" for n, t in s.dtypes) + ", cell string, ord double, pd array<double>") for s in out]


def euclidean(dims: int = PIVOTS) -> Space:
    """Distances of vectors: bounds from pivots; matrix products find what may be near, plain sums decide."""
    low, high = (F.array(*[f(F.get("pd", F.lit(i))) for i in range(dims)]) for f in (F.min, F.max))
    apart = F.array_max(F.zip_with(F.zip_with("q_lo", "c_hi", lambda a, b: a - b), F.zip_with("c_lo", "q_hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    between = F.zip_with(F.zip_with("q_lo", "q_hi", lambda a, b: a + b), F.zip_with("c_lo", "c_hi", lambda a, b: a + b), lambda a, b: F.abs(a - b) / 2)
    least = F.greatest(F.lit(0.0), F.coalesce(apart, F.lit(0.0)) * (1 - 1e-9) - 1e-12)

    def squares(x):
        return np.einsum("ij,ij->i", x, x)

    def values(q, c):
        x, y = _stacked(q), _stacked(c)
        own = np.asarray(q.column("id"))[:, None] == np.asarray(c.column("id"))[None, :]
        d = squares(x)[:, None] + squares(y)[None, :] - 2 * (x @ y.T)
        d = np.sqrt(np.maximum(d, 0))
        d[own] = np.inf
        return d

    def slack(q, c):
        x, y = squares(_stacked(q)), squares(_stacked(c))
        size = x + (y.max() if len(y) else 0)
        # an error e of a square moves its root by sqrt(e) at most
        return np.sqrt(size * (_stacked(q).shape[1] + 8) * 2.0**-50) + 1e-300

    def sure(q, c, r, col):
        x, y = _stacked(q), _stacked(c)
        sq = np.zeros(len(r))
        for a, b in zip(x.T, y.T, strict=True):
            gap = a[r] - b[col]
            sq += gap * gap
        return np.sqrt(sq)

    return Space(about=[low.alias("lo"), high.alias("hi")], least=least, near=F.coalesce(F.array_max(between), F.lit(0.0)),
                 metric=Metric(values, slack, sure), payload=["vec"])


# --------------------------------------------------------------------------- records

def gower(feats: Sequence[str], numeric: Sequence[str], far: bool) -> Space:
    """Mean of scaled gaps and mismatches over the query's non-null columns (S8); ``far`` turns it round.

    Bit i of ``nulls`` tells that ``feats[i]`` is null; ``mn_`` and ``mx_`` are the candidates' range for the
    query. Rows of a block agree in ``nulls``. Columns count with their gap between the blocks' ranges (or
    the largest one, if ``far``) over the widest (narrowest) range that a query of the block has.
    """
    num = [c for c in feats if c in numeric]
    about = [F.first("nulls").alias("nulls"), *[f(c).alias(f"{p}_{c}") for c in feats for p, f in (("lo", F.min), ("hi", F.max))]]
    about += [F.first(f"{e}_{c}").alias(f"{e}_{c}") for c in num for e in ("mn", "mx")]
    full = (1 << len(feats)) - 1
    total, centre = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(feats):
        qlo, qhi, clo, chi = (F.col(f"{s}_{e}_{c}") for s in "qc" for e in ("lo", "hi"))
        present = F.col("q_nulls").bitwiseAND(F.lit(1 << i)) == 0
        if c in num:
            mn, mx = F.col(f"q_mn_{c}"), F.col(f"q_mx_{c}")
            wide, narrow = F.greatest(mx, qhi) - F.least(mn, qlo), mx - mn
            gap = F.greatest(clo - qhi, qlo - chi, F.lit(0.0))
            reach = F.greatest(chi - qlo, qhi - clo)
            term = F.least(F.lit(1.0), F.when(narrow > 0, reach / narrow).otherwise(F.lit(1.0))) if far else F.when(wide > 0, gap / wide).otherwise(F.lit(0.0))
            centre = centre + F.when(present & (wide > 0), F.abs(qlo + qhi - clo - chi) / wide).otherwise(F.lit(0.0))
        elif far:
            term = F.when((qlo == qhi) & (clo == chi) & (qlo == clo), F.lit(0.0)).otherwise(F.lit(1.0))
        else:
            term = F.when((qlo > chi) | (clo > qhi), F.lit(1.0)).otherwise(F.lit(0.0))
        total = total + F.when(present, F.coalesce(term, F.lit(1.0 if far else 0.0))).otherwise(F.lit(0.0))
    used = F.greatest(F.lit(1), F.bit_count(F.lit(full) - F.col("q_nulls")))
    least = -(total / used) * (1 + 1e-9) - 1e-12 if far else total / used * (1 - 1e-9) - 1e-12
    meet = F.col("c_nulls").bitwiseAND(F.lit(full) - F.col("q_nulls")) == 0

    def values(q, c):
        c_null, q_null = c.column("nulls").to_numpy(), q.column("nulls").to_numpy()
        complete = (c_null[None, :] & (full ^ q_null)[:, None]) == 0
        sums, seen = np.zeros(complete.shape), np.zeros(len(q_null))
        for i, f in enumerate(feats):
            here = (q_null >> i) & 1 == 0
            if not here.any():
                continue
            a, b = q.column(f), c.column(f)
            if f in num:
                x, y = a.to_numpy().astype(float), b.to_numpy().astype(float)
                r = np.fmax(q.column(f"mx_{f}").to_numpy().astype(float), x) - np.fmin(q.column(f"mn_{f}").to_numpy().astype(float), x)
                some = here & (r > 0)
                term = np.abs(y[None, :] - x[:, None]) / np.where(some, r, 1.0)[:, None]
                sums += np.where(some[:, None] & complete, term, 0.0)
            else:
                codes = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                codes = np.nan_to_num(codes.astype(float), nan=-1.0)
                sums += (codes[: len(here), None] != codes[None, len(here) :]) & here[:, None]
            seen += here
        d = sums / np.maximum(seen, 1)[:, None]
        return np.where(complete, -d if far else d, np.inf)

    return Space(about=about, least=least, near=-centre if far else centre, metric=Metric(values), payload=["nulls", *feats],
                 extra=[f"{e}_{c}" for c in num for e in ("mn", "mx")], meet=meet)


#: An infinite distance, which is one all the same.
FAR = 1e308


def shared_columns(features: Sequence[str]) -> Space:
    """Euclidean distance over the columns that both have, times all columns over these; none for records that share no column.

    Bit i of ``nulls`` tells that ``features[i]`` is null; rows of a block agree in it. Columns count
    with their gap between the blocks' ranges.
    """
    about = [F.first("nulls").alias("nulls"), *[f(c).alias(f"{p}_{c}") for c in features for p, f in (("lo", F.min), ("hi", F.max))]]
    total, centre = F.lit(0.0), F.lit(0.0)
    for c in features:
        qlo, qhi, clo, chi = (F.col(f"{s}_{e}_{c}") for s in "qc" for e in ("lo", "hi"))
        gap = F.greatest(clo - qhi, qlo - chi, F.lit(0.0))
        middle = qlo + qhi - clo - chi
        both = qlo.isNotNull() & clo.isNotNull()
        total = total + F.when(both, gap * gap).otherwise(F.lit(0.0))
        centre = centre + F.when(both, middle * middle).otherwise(F.lit(0.0))
    full = (1 << len(features)) - 1
    shared = F.bit_count(F.lit(full) - F.col("q_nulls").bitwiseOR(F.col("c_nulls")))
    least = F.sqrt(total * (F.lit(len(features)) / F.greatest(shared, F.lit(1)))) * (1 - 1e-9) - 1e-12
    # a range with a value that is not finite tells nothing, or that the distance is
    least = F.when(F.isnan(least) | least.isNull(), F.lit(0.0)).otherwise(F.least(least, F.lit(FAR / 2)))

    def values(q, c):
        sq, present = np.zeros((q.num_rows, c.num_rows)), np.zeros((q.num_rows, c.num_rows))
        for f in features:
            gap = q.column(f).to_numpy().astype(float)[:, None] - c.column(f).to_numpy().astype(float)[None, :]
            both = ~np.isnan(gap)
            sq += np.where(both, gap, 0.0) ** 2
            present += both
        dist = np.minimum(np.sqrt(sq * (len(features) / np.maximum(present, 1))), FAR)
        return np.where(present > 0, dist, np.inf)

    return Space(about=about, least=least, near=centre, metric=Metric(values), payload=["nulls", *features], meet=shared > 0)


def record_cells(rows: DataFrame, cuts: dict[str, list[float]], categorical: Sequence[str]) -> DataFrame:
    """``rows`` with ``cell`` and ``ord``: like values of the categorical columns, and the same bin of each cut column."""
    bins = [sum((F.when(F.col(c) > x, 1).otherwise(0) for x in at), F.lit(0)) for c, at in cuts.items() if at]
    parts = [F.col("nulls").cast("string"), *[F.coalesce(F.col(c), F.lit("\u0000")) for c in categorical], *[b.cast("string") for b in bins]]
    first = next(iter(cuts), None)
    return rows.withColumn("cell", F.xxhash64(*parts).cast("string")).withColumn("ord", F.coalesce(F.col(first), F.lit(0.0)) if first else F.lit(0.0))


def bin_cuts(rows: DataFrame, columns: Sequence[str], cells: float) -> dict[str, list[float]]:
    """Approximate quantiles that cut the columns into about ``cells`` cells together; no cuts where there would be less than two bins."""
    columns = list(columns)[: max(1, int(math.log2(max(cells, 2))))]
    bins = int(max(cells, 1) ** (1 / max(len(columns), 1)) + 1e-9)
    if not columns or bins < 2:
        return {c: [] for c in columns}
    got = rows.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in columns]).first()
    return {c: sorted(set(got[c] or [])) for c in columns}


def even_cuts(rows: DataFrame, columns: Sequence[str], cells: float) -> dict[str, list[float]]:
    """Approximate quantiles that cut the columns, the widest first, into about ``cells`` cells of even sides."""
    got = rows.agg(*[F.percentile_approx(c, [i / 64 for i in range(1, 64)], 1000).alias(c) for c in columns]).first()
    with np.errstate(invalid="ignore"):
        width = {c: float(np.nan_to_num(np.float64(got[c][59]) - np.float64(got[c][3]))) if got[c] else 0.0 for c in columns}
    bins = dict.fromkeys(sorted(columns, key=lambda c: -width[c]), 1)
    while math.prod(bins.values()) < cells:
        widest = max((c for c in bins if width[c] > 0 and bins[c] < 64), key=lambda c: width[c] / bins[c], default=None)
        if widest is None:
            break
        bins[widest] += 1
    return {c: sorted({got[c][round(i * 64 / n) - 1] for i in range(1, n)}) for c, n in bins.items()}


# --------------------------------------------------------------------------- farthest records

#: Candidates that are looked through in one task for those on the outside.
SHARE_ROWS = 200_000
#: Numeric columns at most (every choice of directions is looked at), and kinds of records.
DIRECTIONS, KINDS = 8, 4096
#: Sums that differ by less may only differ by rounding.
CLOSE = 1e-9


def kind(cl: Column, nulls: Column, feats: Sequence[str], categorical: Sequence[str]) -> Column:
    """The categorical values of a record among the columns that ``nulls`` leaves, with ``cl`` and ``nulls``."""
    kept = [F.when(nulls.bitwiseAND(F.lit(1 << i)) == 0, F.col(c)).alias(c) for i, c in enumerate(feats) if c in categorical]
    return F.to_json(F.struct(cl.alias("cl"), nulls.alias("nulls"), *kept))


def _places(table: pa.Table, feats: Sequence[str], num: Sequence[str]) -> np.ndarray:
    """The numbers of the columns that the queries have, as shares of the candidates' range."""
    here = ~table.column("p_nulls").to_numpy()[0] if table.num_rows else 0
    out = np.zeros((table.num_rows, len(num)))
    for j, c in enumerate(num):
        low, high = (table.column(f"{e}_{c}").to_numpy()[0] if table.num_rows else 0.0 for e in ("p_mn", "p_mx"))
        if here >> feats.index(c) & 1 and high > low:
            out[:, j] = (table.column(c).to_numpy().astype(float) - low) / (high - low)
    return out


def _directions(places: np.ndarray) -> Iterator[np.ndarray]:
    """The sums of the numbers with each choice of signs; columns without a spread have one sign."""
    used = [j for j in range(places.shape[1]) if len(places) and np.ptp(places[:, j]) > 0]
    for signs in itertools.product((-1.0, 1.0), repeat=len(used)):
        yield places[:, used] @ np.array(signs)


def _outermost(feats: Sequence[str], num: Sequence[str], k: int):
    """Of candidates that agree in their categories, those among the ``k`` first in some direction."""
    def pick(table: pa.Table) -> pa.Table:
        places = _places(table, feats, num)
        _, same = np.unique(places, axis=0, return_inverse=True)
        _, by_id = np.unique(table.column("id").to_pandas().to_numpy(), return_inverse=True) if not table.column("id").null_count else (None, np.zeros(len(same)))
        order = np.lexsort((by_id, same.ravel()))
        group = same.ravel()[order]
        rows = np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) < k])  # of equal ones the first k
        keep = np.zeros(len(rows), bool)
        for score in _directions(places[rows]):
            keep |= score >= (np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf) - CLOSE
        return table.take(pa.array(rows[keep]))

    return pick


def _opposite(feats: Sequence[str], num: Sequence[str], k: int):
    """For each kind of query the candidates among the ``k`` first in some direction, mismatches counted."""
    cats = [c for c in feats if c not in num]

    def pick(kinds: pa.Table, table: pa.Table) -> pa.Table:
        if not kinds.num_rows or not table.num_rows:
            return table.slice(0, 0)
        here = ~table.column("p_nulls").to_numpy()[0]
        own = [c for c in cats if here >> feats.index(c) & 1]
        n = kinds.num_rows
        codes = []
        for c in own:
            both = pa.chunked_array([*kinds.column(c).chunks, *table.column(c).chunks], kinds.column(c).type)
            codes.append(both.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))
        keys, parts = kinds.column("kind"), []
        found = [set() for _ in range(n)]
        for score in _directions(_places(table, feats, num)):
            order = np.argsort(-score, kind="stable")
            for a in range(0, n, 256):
                mine = np.arange(a, min(a + 256, n))
                sums = np.empty((len(mine), 0))
                for x in range(0, len(order), 1024):
                    now = order[x : x + 1024]
                    part = np.repeat(score[now][None, :], len(mine), axis=0)
                    for c in codes:
                        part += c[mine][:, None] != c[n + now][None, :]
                    sums = np.concatenate([sums, part], axis=1)
                    last = x + 1024 >= len(order)
                    kth = np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] >= k else np.full(len(mine), -np.inf)
                    if not last and (kth - CLOSE > len(codes) + score[order[x + 1024]]).all():
                        break  # what follows is nearer, whatever its categories
                for i, j in zip(*np.nonzero(sums >= (kth - CLOSE)[:, None]), strict=True):
                    found[mine[i]].add(int(order[j]))
        for i, rows in enumerate(found):
            part = table.take(pa.array(sorted(rows), pa.int64()))
            parts.append(part.set_column(part.schema.get_field_index("kind"), "kind", pa.array([keys[i].as_py()] * part.num_rows, pa.string())))
        return pa.concat_tables(parts).combine_chunks()

    return pick


def farthest_candidates(kinds: DataFrame, candidates: DataFrame, feats: Sequence[str], num: Sequence[str], k: int, shares: int) -> DataFrame:
    """For each kind of query the candidates that can be among the ``k`` farthest of any query of that kind (and few others).

    A sum of gaps is the largest of the sums of differences over all choices of signs. Whoever is among the
    farthest of a query is so in the direction of its own signs, where every candidate that comes before it
    is at least as far. So the ``k`` first in each direction suffice: of each group of equal categories
    (cut into ``shares``), and then over all groups with the mismatches added. This holds for queries
    within the candidates' range. ``kinds``: p_cl, p_nulls, kind, categories; ``candidates``: id, value,
    the columns, p_cl, p_nulls, their range ``p_mn_``, ``p_mx_`` and the kind of query that equals them.
    """
    schema = candidates.schema
    outer = _outermost(feats, num, k)
    if shares > 1:
        share = F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")
        candidates = candidates.groupBy("kind", share).applyInArrow(outer, schema)
    candidates = candidates.groupBy("kind").applyInArrow(outer, schema)
    return kinds.groupBy("p_cl", "p_nulls").cogroup(candidates.groupBy("p_cl", "p_nulls")).applyInArrow(_opposite(feats, num, k), schema)
