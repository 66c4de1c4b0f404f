"""Chained equations from cross sums (I4 ``ice`` / ``mice``; S10, S18).

Numbers are standardised, codes become factors with one indicator a level (the first is the base), so
a code's size never matters. Columns are visited by ascending share of missing cells. The model of a
column is solved from one aggregate over the rows where it is observed: the cross sums of the
design of all other columns (number x number, level x number, level x level) and of the column itself.

* numbers: least squares;
* codes: multinomial logistic, started at the discriminant solution, which has closed form, and
  improved by steps under a fixed bound of the curvature (each needs one more aggregate of
  design x probabilities and never lowers the likelihood).

Only originally missing cells change; numbers are clipped to the observed range, codes are levels that
were observed. Models fitted since the last checkpoint are applied to a row as it is read, and a
round ends with one checkpoint. Rows are kept in blocks, whose cells are bytes, so a pass costs its sums and no conversion of rows. What reaches the driver is the cross sums, whatever the rows.

``mice`` carries several imputations side by side through the same passes. Each draws its own
coefficients from their posterior, residuals by a hash of the key, and codes by their probabilities. At
the end numbers are matched: a cell takes the observed value of the donor whose prediction is
nearest to its own (:func:`nearest_donors`). The imputations are averaged, codes by vote (ties to the
lowest code).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.session import cut_lineage, forgotten, written

#: Levels of a code at most; a column with more is no factor (see ``impute_nearest_code``).
MAX_LEVELS = 1000
RIDGE = 1e-6
#: Rows of a part in which donors are sought, about.
PART_ROWS = 1_000_000

#: Rows of a block of the state at most.
BLOCK_ROWS = 10_000

_STATE = "key array<{}>, kh binary, obs binary, cur binary"


@dataclass
class Variable:
    """One column: its levels if it is a code, else its mean, spread and range (both standardised)."""

    name: str
    levels: list | None = None
    mean: float = 0.0
    sd: float = 1.0
    low: float = 0.0
    high: float = 0.0

    @property
    def width(self) -> int:
        return 1 if self.levels is None else max(len(self.levels) - 1, 0)


@dataclass
class Design:
    """The columns of a table as a matrix: an intercept, numbers, indicators of levels."""

    columns: list[Variable]
    imputations: int = 1

    def width(self, target: int) -> int:
        return 1 + sum(c.width for i, c in enumerate(self.columns) if i != target)

    def matrix(self, values: np.ndarray, target: int) -> np.ndarray:
        """Rows of ``values`` (number, or place of the level) without column ``target``."""
        x = np.zeros((len(values), self.width(target)))
        x[:, 0] = 1.0
        at = 1
        for i, c in enumerate(self.columns):
            if i == target:
                continue
            if c.levels is None:
                x[:, at] = values[:, i]
            else:
                level = values[:, i].astype(np.int64)
                rows = np.flatnonzero(level > 0)
                x[rows, at + level[rows] - 1] = 1.0
            at += c.width
        return x


@dataclass
class Fitted:
    """The model of one column, for each imputation: coefficients (design x outcomes), and the spread of residuals."""

    target: int
    weights: list[np.ndarray]
    sd: list[float] = field(default_factory=list)
    seed: int | None = None


def _uniform(kh: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) by a hash of the key and the seed."""
    x = kh.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53 + 2.0**-54


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of all levels; ``weights`` are against the first one."""
    s = np.concatenate([np.zeros((len(x), 1)), x @ weights], axis=1)
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def apply_models(design: Design, models: Sequence[Fitted], kh: np.ndarray, obs: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """``cur`` (row, imputation, column) after the models, in turn; observed cells stay."""
    cur = cur.copy()
    for model in models:
        t = model.target
        rows = np.flatnonzero(np.isnan(obs[:, t]))
        if not len(rows):
            continue
        column = design.columns[t]
        for i, w in enumerate(model.weights):
            x = design.matrix(cur[rows, i], t)
            if column.levels is None:
                p = x @ w[:, 0]
                if model.seed is not None:
                    u, v = (_uniform(kh[rows], 2 * (model.seed * 131 + i) + j) for j in (0, 1))
                    p = p + model.sd[i] * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
                cur[rows, i, t] = np.clip(p, column.low, column.high)
            else:
                p = probabilities(x, w)
                if model.seed is None:
                    cur[rows, i, t] = np.argmax(p, axis=1)
                else:
                    u = _uniform(kh[rows], model.seed * 131 + i)
                    cur[rows, i, t] = np.minimum((np.cumsum(p, axis=1) < u[:, None]).sum(axis=1), p.shape[1] - 1)
    return cur


def _pack(batches: Iterator[pa.RecordBatch]):
    """Blocks of rows: their cells as bytes, which later passes take as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            cells = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for c in ("obs", "cur")]
            yield _block(part.column("key"), part.column("kh").to_numpy(), *cells)


def _block(key: pa.Array, kh: np.ndarray, obs: np.ndarray, cur: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    keys = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key)
    cells = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (kh, obs, cur)]
    return pa.RecordBatch.from_arrays([keys, *cells, *(pa.array([a], pa.list_(pa.float64())) for a in more.values())], names=["key", "kh", "obs", "cur", *more])


def _arrays(batches: Iterator[pa.RecordBatch], design: Design, models: Sequence[Fitted]):
    """Of each block the keys, their hashes, the observed cells, and all cells after ``models`` and as they are."""
    n = len(design.columns)
    for batch in batches:
        for i in range(batch.num_rows):
            kh, obs, cur = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("kh", np.int64), ("obs", float), ("cur", float)))
            obs, cur = obs.reshape(-1, n), cur.reshape(-1, design.imputations, n)
            yield batch.column("key")[i].values, kh, obs, apply_models(design, models, kh, obs, cur), cur


def in_blocks(state: DataFrame) -> DataFrame:
    """A state of rows as one of blocks."""
    types = dict(state.dtypes)
    return state if types["obs"] == "binary" else state.mapInArrow(_pack, _STATE.format(types["key"]))


def _rows(names: Sequence[str]):
    """The rows of the blocks, with these columns."""
    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("key")[i].values
                cols = {"key": key, "kh": pa.array(np.frombuffer(batch.column("kh")[i].as_buffer(), np.int64))}
                for c in ("obs", "cur"):
                    cells = np.frombuffer(batch.column(c)[i].as_buffer(), float)
                    places = pa.array(np.arange(len(key) + 1) * (len(cells) // max(len(key), 1)), pa.int32())
                    cols[c] = pa.ListArray.from_arrays(places, pa.array(cells))
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=list(names))

    return unpack


def _sums(design: Design, models: list[Fitted], target: int, now: Fitted | None):
    """Cross sums for each imputation: design x (design, outcome), or with ``now`` design x its probabilities."""
    column = design.columns[target]

    def add(batches):
        total = None
        for _, _, obs, cur, _ in _arrays(batches, design, models):
            rows = np.flatnonzero(~np.isnan(obs[:, target]))
            y = obs[rows, target]
            for i in range(design.imputations):
                x = design.matrix(cur[rows, i], target)
                if now is not None:
                    part = x.T @ probabilities(x, now.weights[i])
                elif column.levels is None:
                    part = np.concatenate([x.T @ x, (x.T @ y)[:, None], np.full((x.shape[1], 1), y @ y)], axis=1)
                else:
                    hot = np.zeros((len(y), len(column.levels)))
                    hot[np.arange(len(y)), y.astype(np.int64)] = 1.0
                    part = x.T @ np.concatenate([x, hot], axis=1)
                if total is None:
                    total = np.zeros((design.imputations, *part.shape))
                total[i] += part
        if total is not None:
            m, d, w = total.shape
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(m * d, dtype=np.int32)), pa.array(list(total.reshape(m * d, w)), pa.list_(pa.float64()))], names=["r", "v"])

    return add


def _collect(state: DataFrame, design: Design, models: list[Fitted], target: int, now: Fitted | None = None) -> np.ndarray:
    rows = in_blocks(state).mapInArrow(_sums(design, models, target, now), "r int, v array<double>")
    each = rows.select("r", F.posexplode("v").alias("c", "v")).groupBy("r", "c").agg(F.sum("v").alias("v")).collect()
    d = design.width(target)
    out = np.zeros((design.imputations * d, 1 + max((r.c for r in each), default=0)))
    for r in each:
        out[r.r, r.c] = r.v
    return out.reshape(design.imputations, d, -1)


def _least_squares(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The exact solution; the shortest one where columns of the design depend on each other."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram / scale[:, None] / scale[None, :]
    return np.linalg.lstsq(unit, right / scale, rcond=1e-11)[0] / scale


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    ridge = RIDGE * max(gram[0, 0], 1.0) * np.eye(len(gram))
    ridge[0, 0] = 1e-12
    return np.linalg.solve(gram + ridge, right)


def discriminant(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The closed-form logits (design x levels but the first) of levels that share a covariance.

    ``gram``: design x design sums with the intercept first, ``hot``: design x level sums.
    """
    n = hot[0]
    seen = np.maximum(n, 1e-9)
    means = hot[1:] / seen
    within = (gram[1:, 1:] - (means * n) @ means.T) / max(gram[0, 0], 1.0)
    within = within + (1e-3 * max(np.trace(within) / max(len(within), 1), 1e-6)) * np.eye(len(within))
    slope = np.linalg.solve(within, means) if len(within) else means
    base = np.log((n + 0.5) / (n.sum() + 0.5 * len(n))) - 0.5 * (means * slope).sum(axis=0)
    logits = np.concatenate([base[None, :], slope], axis=0)
    return logits[:, 1:] - logits[:, :1]


def fit_column(state: DataFrame, design: Design, models: list[Fitted], target: int, steps: int, seed: int | None) -> Fitted:
    """The model of one column, for each imputation; with ``seed`` its coefficients are drawn from their posterior."""
    column, m = design.columns[target], design.imputations
    sums = _collect(state, design, models, target)
    d = design.width(target)
    grams = sums[:, :, :d]
    rng = None if seed is None else np.random.default_rng(seed)
    if column.levels is None:
        out = Fitted(target, [], [], seed)
        for i in range(m):
            g, xy, yy = grams[i], sums[i][:, d], sums[i][0, d + 1]
            w = _least_squares(g, xy)
            n = g[0, 0]
            sse = max(yy - 2 * w @ xy + w @ g @ w, 0.0)
            free = max(n - d, 1.0)
            sd = np.sqrt(sse / free)
            if rng is not None:
                sd = np.sqrt(sse / rng.chisquare(free))
                root = np.linalg.cholesky(np.linalg.inv(g + RIDGE * max(n, 1.0) * np.eye(d)) + 1e-15 * np.eye(d))
                w = w + sd * root @ rng.standard_normal(d)
            out.weights.append(w[:, None])
            out.sd.append(float(sd))
        return out
    k = len(column.levels)
    out = Fitted(target, [discriminant(grams[i], sums[i][:, d:]) for i in range(m)], [0.0] * m, seed)
    for _ in range(steps if k > 1 else 0):
        expected = _collect(state, design, models, target, out)
        moved = 0.0
        for i in range(m):
            up = sums[i][:, d + 1 :] - expected[i][:, 1:] - RIDGE * grams[i][0, 0] * out.weights[i]
            step = 2 * _solve(grams[i], up)
            step = step + step.sum(axis=1, keepdims=True)
            out.weights[i] = out.weights[i] + step
            moved = max(moved, float(np.abs(step).max(initial=0.0)))
        if moved < 1e-3:
            break
    if rng is not None and k > 1:
        for i in range(m):
            inner = np.linalg.cholesky(np.linalg.inv(grams[i] + RIDGE * max(grams[i][0, 0], 1.0) * np.eye(d)) + 1e-15 * np.eye(d))
            outer = np.linalg.cholesky(2 * (np.eye(k - 1) + 1))
            out.weights[i] = out.weights[i] + inner @ rng.standard_normal((d, k - 1)) @ outer.T
    return out


# --------------------------------------------------------------------------- the chain

def describe(df: DataFrame, cols: Sequence[str], codes: Sequence[str]) -> tuple[list[Variable], dict[str, float]]:
    """The columns' levels or scales, and their share of missing cells. Columns without a value are left out."""
    codes = [c for c in cols if c in set(codes)]
    numbers = [c for c in cols if c not in codes]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(f"n_{c}") for c in cols],
                 *[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in numbers for p, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    out, missing = [], {}
    for c in cols:
        if not row[f"n_{c}"]:
            continue
        missing[c] = 1 - row[f"n_{c}"] / row["__rows"]
        if c in codes:
            levels = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(MAX_LEVELS + 1).collect()]
            if len(levels) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
            out.append(Variable(c, levels))
        else:
            sd = row[f"sd_{c}"] or 1.0
            mean = row[f"mean_{c}"]
            out.append(Variable(c, None, mean, sd, (row[f"lo_{c}"] - mean) / sd, (row[f"hi_{c}"] - mean) / sd))
    return out, missing


def _start(df: DataFrame, key: str, design: Design) -> DataFrame:
    """The state: key, its hash, observed cells (null where missing) and for each imputation all cells, missing ones at mean or mode."""
    obs, start = [], []
    modes = {}
    for c in design.columns:
        if c.levels is None:
            obs.append((F.col(c.name).cast("double") - c.mean) / c.sd)
            start.append(F.lit(0.0))
        else:
            if c.name not in modes:
                top = df.where(F.col(c.name).isNotNull()).groupBy(c.name).count().orderBy(F.desc("count"), c.name).first()
                modes[c.name] = c.levels.index(top[0])
            at = F.array_position(F.array(*[F.lit(v) for v in c.levels]), F.col(c.name)).cast("double") - 1
            obs.append(F.when(F.col(c.name).isNotNull(), at))
            start.append(F.lit(float(modes[c.name])))
    full = [F.coalesce(o, s) for o, s in zip(obs, start, strict=True)] * design.imputations
    return df.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("kh"), F.array(*obs).alias("obs"), F.array(*full).alias("cur"))


def _advance(design: Design, models: list[Fitted]):
    """The state after the models, with the change of each column's missing cells against the state read, by block."""
    def step(batches):
        codes = np.array([c.levels is not None for c in design.columns])
        for key, kh, obs, new, old in _arrays(batches, design, models):
            gone = np.isnan(obs)[:, None, :] & np.ones((1, new.shape[1], 1), bool)
            delta = np.where(codes, new != old, np.abs(new - old))
            delta = np.where(gone, delta, 0.0).sum(axis=(0, 1))
            size = np.where(gone, np.where(codes, 1.0, np.maximum(np.abs(old), 1.0)), 0.0).sum(axis=(0, 1))
            yield _block(key, kh, obs, new, delta=delta, size=size)

    return step


def chained_equations(df: DataFrame, cols: Sequence[str], key: str = "row_id", categorical: Sequence[str] = (), max_rounds: int = 10,
                      tol: float = 1e-3, imputations: int = 1, draw: bool = False, steps: int = 2, match: bool = True,
                      seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fills ``cols`` and tells how it went: ``(filled, report)``.

    ``report``: ``round, column, change, converged``; the change of a round is the mean move of a
    column's missing cells, in spreads of the column (codes: the share that changed). Rounds end when
    no column moves by ``tol``, or after ``max_rounds``; draws never settle, so with ``draw`` all
    rounds are done. Rows keep their key and observed cells; numbers become doubles, codes keep their
    type. A column without any value stays as it is. Keys must be unique.
    """
    spark = df.sparkSession
    columns, missing = describe(df, cols, categorical)
    design = Design(columns, imputations)
    order = sorted((i for i, c in enumerate(columns) if missing[c.name] > 0), key=lambda i: (missing[columns[i].name], columns[i].name))
    state = cut_lineage(in_blocks(_start(df, key, design)))
    type_ = dict(df.dtypes)[key]
    report = []
    for rnd in range(max_rounds if order else 0):
        models: list[Fitted] = []
        for t in order:
            models.append(fit_column(state, design, models, t, steps, seed + 1000 * rnd + t if draw else None))
        moved = cut_lineage(state.mapInArrow(_advance(design, models), f"{_STATE.format(type_)}, delta array<double>, size array<double>"))
        sums = moved.agg(*[F.sum(F.col(a)[t]).alias(f"{a}{t}") for t in order for a in ("delta", "size")]).first()
        change = {t: (sums[f"delta{t}"] or 0.0) / max(sums[f"size{t}"] or 0.0, 1e-12) for t in order}
        done = not draw and max(change.values()) < tol
        report += [(rnd + 1, columns[t].name, float(change[t]), done) for t in order]
        state = moved.select("key", "kh", "obs", "cur")
        del moved
        forgotten(spark)  # the state before
        if done:
            break
        if len(order) == 1 and not draw and rnd + 1 < max_rounds:  # its regressors never change, so neither would it
            report.append((rnd + 2, columns[order[0]].name, 0.0, True))
            break
    if draw and match and order:
        state = state.mapInArrow(_rows(["key", "kh", "obs", "cur"]), f"key {type_}, kh long, obs array<double>, cur array<double>")
        state = _matched(state, design, models, [t for t in order if columns[t].levels is None], type_)
    else:
        state = state.mapInArrow(_rows(["key", "cur"]), f"key {type_}, cur array<double>")
    out = _finished(df, key, state, design, order)
    return out, spark.createDataFrame(report, "round int, column string, change double, converged boolean")


def _finished(df: DataFrame, key: str, state: DataFrame, design: Design, order: list[int]) -> DataFrame:
    """Mean of the imputations for numbers, the commonest level for codes (the lowest of equals)."""
    n, m = len(design.columns), design.imputations
    fills = []
    for t in order:
        c = design.columns[t]
        cells = F.array(*[F.col("cur")[i * n + t] for i in range(m)])
        if c.levels is None:
            mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / m
            fills.append((mean * c.sd + c.mean).alias(f"__f{t}"))
        else:
            votes = F.array_sort(F.transform(F.array_distinct(cells), lambda v: F.struct((-F.size(F.filter(cells, lambda x: x == v))).alias("n"), v.alias("v"))))
            fills.append(F.array(*[F.lit(v) for v in c.levels])[votes[0]["v"].cast("int")].alias(f"__f{t}"))
    out = df.join(state.select(F.col("key").alias("__key"), *fills), F.col(key) == F.col("__key"), "left")
    names = {design.columns[t].name: t for t in order}
    types = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if c not in names:
            cols.append(F.col(c))
        elif design.columns[names[c]].levels is None:
            cols.append(F.coalesce(F.col(c).cast("double"), F.col(f"__f{names[c]}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(c), F.col(f"__f{names[c]}").cast(types[c])).alias(c))
    return out.select(*cols)


# --------------------------------------------------------------------------- predictive mean matching

def _predicted(design: Design, models: list[Fitted], target: int):
    """Of each row and imputation the prediction without residual; donors have a value (standardised)."""
    mean_only = [Fitted(f.target, f.weights, f.sd, None) for f in models if f.target == target]

    def predict(batches):
        for key, _, obs, cur, _ in _arrays(batches, design, []):
            for i, w in enumerate(mean_only[0].weights):
                p = design.matrix(cur[:, i], target) @ w[:, 0]
                yield pa.RecordBatch.from_arrays([
                    key, pa.array(np.full(len(p), i, np.int32)), pa.array(p), pa.array(obs[:, target], from_pandas=True)],
                    names=["key", "imp", "pred", "value"])

    return predict


def _nearest(edges: dict):
    """For each row without a value, that of the donor nearest in prediction; ``edges`` are the donors next to each part."""
    def look(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        imp, pred = table.column("imp").to_numpy(), table.column("pred").to_numpy()
        value = table.column("value").to_numpy()
        part = table.column("part")[0].as_py()
        for i in np.unique(imp).tolist():
            own = imp == i
            donor = own & ~np.isnan(value)
            need = np.flatnonzero(own & np.isnan(value))
            before, after = edges.get((part, i), ((), ()))
            p = np.array([*(x[0] for x in before), *pred[donor], *(x[0] for x in after)])
            v = np.array([*(x[1] for x in before), *value[donor], *(x[1] for x in after)])
            if not len(need) or not len(p):
                continue
            right = np.clip(np.searchsorted(p, pred[need]), 0, len(p) - 1)
            left = np.maximum(right - 1, 0)
            best = np.where(np.abs(pred[need] - p[left]) <= np.abs(p[right] - pred[need]), left, right)
            yield pa.RecordBatch.from_arrays([
                table.column("key").combine_chunks().take(pa.array(need)), pa.array(np.full(len(need), i, np.int32)), pa.array(v[best])], names=["key", "imp", "donor"])

    return look


def nearest_donors(rows: DataFrame) -> DataFrame:
    """``key, imp, donor`` of the rows (key, imp, pred, value) without a value: the value of the donor of the same ``imp`` nearest in ``pred``.

    Rows are dealt by ranges of (imp, pred) and sorted within; a part also looks at the last donor before it and
    the first one after it, so the result is that of one long sorted list. Equally near: the lower one.
    """
    type_ = dict(rows.dtypes)["key"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, "imp", "pred", "key").sortWithinPartitions("imp", "pred", "value", "key")
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    donor = F.struct("pred", "value")
    ends = dealt.where(F.col("value").isNotNull()).groupBy("part", "imp").agg(F.min(donor).alias("first"), F.max(donor).alias("last"))
    ends = {(e.part, e.imp): (tuple(e["first"]), tuple(e["last"])) for e in ends.collect()}  # two donors a part and imputation at most
    edges: dict = {(p, i): [[], []] for p in range(parts) for i in {i for _, i in ends}}
    for side, walk in ((0, range(parts)), (1, reversed(range(parts)))):
        near: dict = {}
        for p, i in ((p, i) for p in walk for i in {i for _, i in ends}):
            edges[p, i][side] = near.get(i, [])
            if (p, i) in ends:
                near[i] = [ends[p, i][1 - side]]
    return dealt.mapInArrow(_nearest(edges), f"key {type_}, imp int, donor double")


def _matched(state: DataFrame, design: Design, models: list[Fitted], targets: list[int], type_: str) -> DataFrame:
    """The rows with the numbers' missing cells replaced by observed values of the donors nearest in prediction."""
    n = len(design.columns)
    for t in targets:
        rows = in_blocks(state).mapInArrow(_predicted(design, models, t), f"key {type_}, imp int, pred double, value double")
        found = nearest_donors(rows).groupBy("key").pivot("imp", list(range(design.imputations))).agg(F.first("donor"))
        found = found.select(F.col("key").alias("__key"), *[F.col(str(i)).alias(f"__d{i}") for i in range(design.imputations)])
        joined = state.join(found, F.col("key") == F.col("__key"), "left")
        cells = [F.coalesce(F.col(f"__d{i // n}"), F.col("cur")[i]) if i % n == t else F.col("cur")[i] for i in range(n * design.imputations)]
        state = written(joined.select("key", "kh", "obs", F.array(*cells).alias("cur")), "matched")
    return state
