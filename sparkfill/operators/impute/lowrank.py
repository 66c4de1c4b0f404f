"""Multivariate-normal EM (I7) and soft-thresholded SVD (I8) fills.

Both work on sufficient statistics: each round is one aggregate over the table
(sums and cross products), the d x d algebra runs on the driver, and the fitted
matrices come back as literal expressions. EM reads the original table every
round (no lineage growth). SoftImpute takes one aggregate for each way in which cells are missing: a fill
is linear in the cells that are there, so all rounds follow on the driver, and a pass over the rows only
sums how far the cells moved in several rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.operators.impute.registry import register
from sparkfill.session import cut_lineage

#: Ways in which cells of a row are missing at most, and rounds of SoftImpute whose changes are summed in one pass.
MAX_PATTERNS, CHANGES_AT_ONCE = 4096, 20


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    r = df.agg(*aggs).first()
    s = np.array([r[f"s{i}"] or 0.0 for i in range(d)])
    S = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            S[i, j] = S[j, i] = r[f"p{i}_{j}"] or 0.0
    return float(r["n"]), s, S


def _pattern(cols: Sequence[str]) -> Column:
    m = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        m = m + F.shiftleft(F.col(c).isNull().cast("bigint"), i)
    return m


def _scales(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and spread of each column, over its values."""
    st = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [st[f"m{i}"] or 0.0 for i in range(len(cols))], [st[f"s{i}"] or 1.0 for i in range(len(cols))]


def _report(df: DataFrame, changes: list[float], tol: float) -> DataFrame:
    return df.sparkSession.createDataFrame([(i + 1, float(c), bool(c < tol)) for i, c in enumerate(changes)], "round int, change double, converged boolean")


def em_fit(df: DataFrame, cols: Sequence[str], max_rounds: int = 100, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Conditional-mean fill under a multivariate normal fitted by EM (I7): ``(filled, report)``.

    Columns are standardised first, so sums of squares stay small, and the stop rule (the largest change
    of a mean or covariance) doesn't depend on units. ``report``: ``round, change, converged``."""
    cols = list(cols)
    d = len(cols)
    shift, scale = _scales(df, cols)
    z = df.withColumns({c: (F.col(c).cast("double") - F.lit(shift[i])) / F.lit(scale[i]) for i, c in enumerate(cols)})
    base = cut_lineage(z.withColumn("__pat", _pattern(cols)))
    changes: list[float] = []
    pats = {r["__pat"]: r["n"] for r in base.groupBy("__pat").agg(F.count(F.lit(1)).alias("n")).collect()}
    stats = base.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    mu = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    sigma = np.diag([stats[f"v{i}"] or 1.0 for i in range(d)])

    def fill_exprs(mu, sigma):
        exprs, cond_cov = {}, np.zeros((d, d))
        for c_i, c in enumerate(cols):
            e = None
            for p, n in pats.items():
                miss = [i for i in range(d) if p >> i & 1]
                if c_i not in miss:
                    continue
                obs = [i for i in range(d) if not p >> i & 1]
                if obs:
                    B = sigma[np.ix_(miss, obs)] @ np.linalg.pinv(sigma[np.ix_(obs, obs)])
                    row = B[miss.index(c_i)]
                    val = F.lit(float(mu[c_i])) + sum((F.lit(float(row[k])) * (F.col(cols[o]) - F.lit(float(mu[o])))
                                                      for k, o in enumerate(obs)), F.lit(0.0))
                else:
                    val = F.lit(float(mu[c_i]))
                e = F.when(F.col("__pat") == p, val) if e is None else e.when(F.col("__pat") == p, val)
            exprs[c] = F.coalesce(F.col(c), e) if e is not None else F.col(c)
        for p, n in pats.items():
            miss = [i for i in range(d) if p >> i & 1]
            obs = [i for i in range(d) if not p >> i & 1]
            if not miss:
                continue
            Smm = sigma[np.ix_(miss, miss)]
            if obs:
                Smo = sigma[np.ix_(miss, obs)]
                Smm = Smm - Smo @ np.linalg.pinv(sigma[np.ix_(obs, obs)]) @ Smo.T
            cond_cov[np.ix_(miss, miss)] += n * Smm
        return exprs, cond_cov

    for _ in range(max_rounds):
        exprs, cc = fill_exprs(mu, sigma)
        n, s, S = _moments(base.withColumns(exprs), cols)
        new_mu = s / n
        new_sigma = (S + cc) / n - np.outer(new_mu, new_mu)
        changes.append(max(np.max(np.abs(new_mu - mu)), np.max(np.abs(new_sigma - sigma))))
        mu, sigma = new_mu, new_sigma
        if changes[-1] < tol:
            break
    exprs, _ = fill_exprs(mu, sigma)
    out = base.withColumns(exprs).withColumns({c: F.col(c) * F.lit(scale[i]) + F.lit(shift[i]) for i, c in enumerate(cols)})
    return out.drop("__pat"), _report(df, changes, tol)


def em_impute(df: DataFrame, cols: Sequence[str], max_rounds: int = 100, tol: float = 1e-4) -> DataFrame:
    return em_fit(df, cols, max_rounds, tol)[0]


def _by_pattern(batch: pa.RecordBatch, cols: Sequence[str]):
    """The rows of each way in which cells are missing, and their cells with 0 for missing ones."""
    x = np.nan_to_num(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1), nan=0.0)
    coded = batch.column("__pat").dictionary_encode()
    codes = coded.indices.to_numpy()
    return [(p, np.flatnonzero(codes == i)) for i, p in enumerate(coded.dictionary.to_pylist())], x


def _moved(z: DataFrame, cols: Sequence[str], moves: list[dict]) -> list[float]:
    """How far all missing cells move in each of several rounds, from one pass over the rows."""
    def add(batches):
        total = np.zeros(len(moves))
        for batch in batches:
            parts, x = _by_pattern(batch, cols)
            for p, rows in parts:
                for i, move in enumerate(moves):
                    total[i] += np.abs(x[rows] @ move[p].T).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moves), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(len(moves))
    for r in z.select("__pat", *cols).mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.tolist()


def _filled_by(cols: Sequence[str], fills: dict, mu: Sequence[float], sd: Sequence[float]):
    """The rows with their missing cells filled, in the columns' own units."""
    def fill(batches):
        for batch in batches:
            parts, x = _by_pattern(batch, cols)
            for p, rows in parts:
                x[rows] = x[rows] @ fills[p][1].T
            own = {c: pa.array(x[:, i] * sd[i] + mu[i]) for i, c in enumerate(cols)}
            names = [n for n in batch.schema.names if n != "__pat"]
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(n)) for n in names], names=names)

    return fill


def _softimpute_by_rows(df, cols, mu, sd, max_rounds, shrink, tol) -> tuple[DataFrame, DataFrame]:
    """The rounds over the rows themselves, each written down: for tables where cells are missing in very many ways."""
    d = len(cols)
    changes: list[float] = []
    z = df.withColumns({f"__m_{c}": F.col(c).isNull() for c in cols})
    z = cut_lineage(z.withColumns({c: F.coalesce((F.col(c) - F.lit(mu[i])) / F.lit(sd[i]), F.lit(0.0)) for i, c in enumerate(cols)}))
    lam = shrink
    for _ in range(max_rounds):
        n, _, S = _moments(z, cols)
        w, V = np.linalg.eigh(S)
        sv = np.sqrt(np.clip(w, 0, None))
        if lam is None:
            lam = float(sv.max()) / 50.0
        keep = np.where(sv > 0, np.clip(sv - lam, 0, None) / np.where(sv > 0, sv, 1), 0.0)
        M = V @ np.diag(keep) @ V.T
        exprs = {}
        for j, c in enumerate(cols):
            rec = sum((F.lit(float(M[i, j])) * F.col(cols[i]) for i in range(d)), F.lit(0.0))
            exprs[c] = F.when(F.col(f"__m_{c}"), rec).otherwise(F.col(c))
        z = cut_lineage(z.withColumns(exprs | {f"__p_{c}": F.col(c) for c in cols}))
        moved = z.agg(*[F.sum(F.when(F.col(f"__m_{c}"), F.abs(F.col(c) - F.col(f"__p_{c}")))).alias(f"d{i}") for i, c in enumerate(cols)],
                      *[F.count_if(F.col(f"__m_{c}")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        changes.append(sum(moved[f"d{i}"] or 0.0 for i in range(d)) / max(sum(moved[f"n{i}"] for i in range(d)), 1))
        z = z.drop(*[f"__p_{c}" for c in cols])
        if changes[-1] < tol:
            break
    out = z.withColumns({c: F.col(c) * F.lit(sd[i]) + F.lit(mu[i]) for i, c in enumerate(cols)})
    return out.drop(*[f"__m_{c}" for c in cols]), _report(df, changes, tol)


def softimpute_fit(df: DataFrame, cols: Sequence[str], max_rounds: int = 100, shrink: float | None = None,
                   tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Low-rank fill (I8): standardise, nulls start at 0, then repeatedly replace missing cells by
    the row times V diag(max(s - lambda, 0) / s) V' from the eigen-decomposition of the Gram matrix.

    Returns ``(filled, report)``; rounds end when the missing cells move by less than ``tol`` on average, in
    spreads of their columns."""
    cols = list(cols)
    d = len(cols)
    mu, sd = _scales(df, cols)
    z = df.withColumns({c: (F.col(c) - F.lit(mu[i])) / F.lit(sd[i]) for i, c in enumerate(cols)})
    z = cut_lineage(z.withColumn("__pat", F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])))
    # rows that miss the same columns are filled by the same matrix, so their cross sums tell all that a round needs
    known = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    sums = [F.sum(known[i] * known[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = z.groupBy("__pat").agg(F.count(F.lit(1)).alias("__n"), *sums).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        return _softimpute_by_rows(df, cols, mu, sd, max_rounds, shrink, tol)
    grams, fills = {}, {}
    for r in found:
        missing = np.array([x == "1" for x in r["__pat"]])
        grams[r["__pat"]] = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        fills[r["__pat"]] = missing, np.diag(~missing).astype(float)  # all cells from those that are there; missing ones start at 0
    cells = max(sum(int(r["__n"]) * r["__pat"].count("1") for r in found), 1)
    lam = shrink
    changes: list[float] = []
    while len(changes) < max_rounds and (not changes or changes[-1] >= tol):
        rounds = [fills]
        for _ in range(min(CHANGES_AT_ONCE, max_rounds - len(changes))):
            last = rounds[-1]
            w, V = np.linalg.eigh(sum((B @ grams[p] @ B.T for p, (_, B) in last.items()), np.zeros((d, d))))
            sv = np.sqrt(np.clip(w, 0, None))
            if lam is None:
                lam = float(sv.max()) / 50.0
            keep = np.where(sv > 0, np.clip(sv - lam, 0, None) / np.where(sv > 0, sv, 1), 0.0)
            M = V @ np.diag(keep) @ V.T
            rounds.append({p: (m, np.where(m[:, None], M.T @ B, B)) for p, (m, B) in last.items()})
        moves = [{p: new[p][1] - B for p, (_, B) in old.items()} for old, new in itertools.pairwise(rounds)]
        for at, change in enumerate(_moved(z, cols, moves)):
            changes.append(change / cells)
            fills = rounds[at + 1]
            if changes[-1] < tol:
                break
    out = z.mapInArrow(_filled_by(cols, fills, mu, sd), z.drop("__pat").schema) if any(m.any() for m, _ in fills.values()) else \
        z.drop("__pat").withColumns({c: F.col(c) * F.lit(sd[i]) + F.lit(mu[i]) for i, c in enumerate(cols)})
    return out, _report(df, changes, tol)


def softimpute(df: DataFrame, cols: Sequence[str], max_rounds: int = 100, shrink: float | None = None, tol: float = 1e-3) -> DataFrame:
    return softimpute_fit(df, cols, max_rounds, shrink, tol)[0]


@register("EM")
def _em(df, cols, cfg=None):
    cfg = cfg or {}
    return em_impute(df, cols, cfg.get("max_rounds", 100))


@register("softimpute")
def _soft(df, cols, cfg=None):
    cfg = cfg or {}
    return softimpute(df, cols, cfg.get("max_rounds", 100), cfg.get("shrink"))


@register("knn")
def _knn(df, cols, cfg=None):
    """Neighbour fill inside the groups of ``cfg['cluster']``, or in the whole table."""
    from sparkfill.operators.distance import knn_fill
    cfg = cfg or {}
    key, cluster = cfg.get("key", "row_id"), cfg.get("cluster")
    out = df
    for c in cols:
        feats = [x for x in cols if x != c]
        out = knn_fill(out, key, cluster, c, feats, k=cfg.get("k", 5))
    return out
