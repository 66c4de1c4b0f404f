"""Learned synthetic tables (J8): a Gaussian copula over numbers, categories and missing cells.

Every column stands for a hidden standard normal. A number's quantile function turns the hidden value
into the number; a category's shares, in ascending order of its values, cut the hidden line into levels
(latent thresholds). A column with missing cells has a second hidden normal, cut at its missing share,
so that missing cells come where the other columns make them likely.

Fitting reads the table three times, whatever the number of columns: quantiles of the numbers, counts of the
categories, and one aggregate of contingency tables of all column pairs, numbers in ``BINS`` quantile bins. Every
correlation then comes from its table by maximum likelihood of the bivariate normal rectangles: polychoric
for two categories, polyserial for a binned number and a category. Only the tables reach the driver:
at most ``MAX_LEVELS`` squared cells a pair. Sampling is a column expression over ``spark.range(n)``, so
``n`` has nothing to do with the rows of the input.

Defined results: a column without values is null in every row; one with a single value has it
everywhere; a pair that never has values together has correlation 0; an empty table gives rows of nulls; NaN
counts as missing. Integer columns get rounded numbers; every column keeps its type. Nominal categories are
treated in the order of their values, so of an association that follows no order only the part
along that order is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfill.functions.hashing import normal
from sparkfill.functions.ordered import exact_quantiles
from sparkfill.functions.scalars import long_values, nan_to_null
from sparkfill.session import row_count_at_most

GRID = 100          # steps of a number's quantile function
BINS = 20           # bins of a number in contingency tables; divides GRID
MAX_LEVELS = 200    # levels of a categorical column
NODES = 24          # Gauss-Legendre nodes of a bivariate normal probability


@dataclass(frozen=True)
class Model:
    """``hidden``: names of the hidden normals, ``correlation`` theirs; ``missing``: shares of null cells."""
    numeric: dict[str, list[float] | None]
    categorical: dict[str, tuple[list, list[float]]]
    missing: dict[str, float]
    hidden: tuple[str, ...]
    correlation: np.ndarray
    types: dict[str, T.DataType]


def _phi(z: Column) -> Column:
    """Standard normal CDF (Abramowitz-Stegun 7.1.26 on erf, |error| < 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


# --------------------------------------------------------------------------- correlation of two cut normals

def rectangles(a: np.ndarray, b: np.ndarray, angle: float) -> np.ndarray:
    """Probabilities of the rectangles that thresholds ``a`` and ``b`` cut, at correlation ``sin(angle)``.

    The joint distribution function is that of independence plus an integral over the angle, by
    Gauss-Legendre; outer rectangles reach to infinity.
    """
    cdf = NormalDist().cdf
    joint = np.zeros((len(a) + 2, len(b) + 2))
    joint[1:-1, 1:-1] = np.outer([cdf(x) for x in a], [cdf(x) for x in b])
    joint[1:-1, -1], joint[-1, 1:-1], joint[-1, -1] = [cdf(x) for x in a], [cdf(x) for x in b], 1.0
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    h, k = a[:, None], b[None, :]
    for x, w in zip(nodes, weights, strict=True):
        t = angle * (x + 1) / 2
        joint[1:-1, 1:-1] += angle / 2 * w * np.exp(-(h * h - 2 * math.sin(t) * h * k + k * k) / (2 * math.cos(t) ** 2)) / (2 * math.pi)
    return np.diff(np.diff(joint, axis=0), axis=1)


def _thresholds(counts: np.ndarray) -> np.ndarray:
    """Places on the hidden line between levels, of which each has rows."""
    share = np.cumsum(counts)[:-1] / counts.sum()
    return np.array([NormalDist().inv_cdf(min(max(s, 1e-12), 1 - 1e-12)) for s in share])


def polychoric(table: np.ndarray) -> float:
    """Correlation of the hidden normals under which a contingency table is likeliest."""
    table = table[table.sum(1) > 0][:, table.sum(0) > 0]
    if min(table.shape, default=0) < 2:
        return 0.0
    a, b = _thresholds(table.sum(1)), _thresholds(table.sum(0))

    def unlikely(angle: float) -> float:
        return -float((table * np.log(np.maximum(rectangles(a, b, angle), 1e-12))).sum())

    steps = np.linspace(-1.5, 1.5, 25)
    best = int(np.argmin([unlikely(s) for s in steps]))
    low, high = steps[max(best - 1, 0)], steps[min(best + 1, len(steps) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:  # golden section
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, y) if unlikely(x) <= unlikely(y) else (x, high)
    return math.sin((low + high) / 2)


def _nearest_correlation(m: np.ndarray) -> np.ndarray:
    """Pairwise estimates made positive definite, with a diagonal of 1."""
    w, v = np.linalg.eigh(m)
    m = (v * np.clip(w, 1e-6, None)) @ v.T
    s = np.sqrt(np.diag(m))
    return m / np.outer(s, s)


# --------------------------------------------------------------------------- fit

def _clean(real: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    floats = {f.name for f in real.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return real.select(*(nan_to_null(c).alias(c) if c in floats else F.col(c) for c in [*numeric, *categorical]))


def _quantiles(df: DataFrame, numeric: Sequence[str]) -> dict[str, list[float] | None]:
    if not numeric:
        return {}
    lv = long_values(df, [], numeric).where(F.col("value").isNotNull())
    names = [f"g{i}" for i in range(GRID + 1)]
    found = {r["column"]: [r[n] for n in names] for r in exact_quantiles(lv, "column", "value", [i / GRID for i in range(GRID + 1)], names).collect()}
    return {c: found.get(c) for c in numeric}


def _levels(df: DataFrame, categorical: Sequence[str]) -> dict[str, list]:
    """Distinct values of each column, ascending."""
    if not categorical:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical))))
    values = df.select(pairs.alias("p")).select("p.*").where("v is not null").distinct()
    if not row_count_at_most(values, MAX_LEVELS * len(categorical)):
        raise ValueError(f"a categorical column has more than {MAX_LEVELS} levels; treat it as numeric or leave it out")
    out: dict[str, list] = {c: [] for c in categorical}
    for r in values.collect():
        out[categorical[r.i]].append(r.v)
    for c, v in out.items():
        if len(v) > MAX_LEVELS:
            raise ValueError(f"{c} has {len(v)} levels, more than {MAX_LEVELS}; treat it as numeric or leave it out")
        number = isinstance(df.schema[c].dataType, T.NumericType)
        v.sort(key=(lambda x: (float(x), x)) if number else str)
    return out


def _place(column: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` lie below a number."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < column))


def _codes(numeric: dict, levels: dict, missing: Sequence[str]) -> dict[str, Column]:
    """Level of each hidden normal in a row, null where the row doesn't tell."""
    out = {}
    for c, grid in numeric.items():
        cuts = sorted(set(grid[GRID // BINS : GRID : GRID // BINS])) if grid else []
        out[c] = F.when(F.col(c).isNotNull(), _place(F.col(c).cast("double"), cuts))
    for c, values in levels.items():
        place = F.array_position(F.array(*map(F.lit, values)), F.col(c).cast("string")) - 1 if values else F.lit(None)
        out[c] = place.cast("int")
    for c in missing:
        out[f"{c} missing"] = F.col(c).isNull().cast("int")
    return out


def _tables(df: DataFrame, codes: dict[str, Column]) -> dict[tuple[int, int], np.ndarray]:
    """Contingency tables of all pairs of codes, each with itself included, from one aggregate."""
    names = [f"c{i}" for i in range(len(codes))]
    coded = df.select(*(e.alias(n) for n, e in zip(names, codes.values(), strict=True)))
    cells = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(i + j).alias("j"), F.col(a).alias("a"), F.col(b).alias("b")))
             for i, a in enumerate(names) for j, b in enumerate(names[i:])]
    counts = coded.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("p")).groupBy("p").agg(F.count("p").alias("n"))
    found: dict[tuple[int, int], list] = {}
    for r in counts.select("p.*", "n").collect():  # at most MAX_LEVELS squared cells a pair
        found.setdefault((r.i, r.j), []).append((r.a, r.b, r.n))
    out = {}
    for pair, rows in found.items():
        a, b, n = (np.array(x) for x in zip(*rows, strict=True))
        out[pair] = np.zeros((a.max() + 1, b.max() + 1))
        out[pair][a, b] = n
    return out


def fit(real: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Model:
    """Margins and hidden correlations of the named columns of ``real``; other columns are not read."""
    df = _clean(real, numeric, categorical)
    columns = [*numeric, *categorical]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"n{i}") for i, c in enumerate(columns))).first()
    missing = {c: 1 - row[f"n{i}"] / row["rows"] if row["rows"] else 1.0 for i, c in enumerate(columns)}
    grids, levels = _quantiles(df, numeric), _levels(df, categorical)
    codes = _codes(grids, levels, [c for c in columns if 0 < missing[c] < 1])
    tables = _tables(df, codes) if codes else {}
    shares = {}
    for i, c in enumerate(codes):
        if c in levels:
            n = np.diag(tables[i, i]) if (i, i) in tables else np.zeros(0)
            shares[c] = (levels[c], (n / n.sum()).tolist() if n.sum() else [])
    m = np.eye(len(codes))
    own = {f"{c} missing": c for c in columns}
    names = tuple(codes)
    for (i, j), table in tables.items():
        if i < j and own.get(names[j]) != names[i]:  # a cell's value says nothing of whether it is missing: it isn't
            m[i, j] = m[j, i] = polychoric(table)
    m = _nearest_correlation(m) if len(m) else m
    return Model(grids, shares, missing, names, m, {f.name: f.dataType for f in df.schema})


# --------------------------------------------------------------------------- sample

def sample(spark: SparkSession, model: Model, n: int, key: str = "row_id", seed: str = "copula") -> DataFrame:
    """``n`` synthetic rows with ``key`` 0 to n - 1; the same seed gives the same rows on any cluster."""
    k = F.col("id")
    own = {c: i for i, c in enumerate(model.hidden)}
    base = spark.range(n)
    independent = base.select("id", *(normal(f"{seed}:{i}", k).alias(f"e{i}") for i in own.values()))
    root = np.linalg.cholesky(model.correlation) if own else np.zeros((0, 0))
    mixed = independent.select("id", *(
        _phi(sum((F.lit(float(root[i, j])) * F.col(f"e{j}") for j in range(i + 1)), F.lit(0.0))).alias(f"u{i}") for i in own.values()))

    def value(c: str) -> Column:
        kind = model.types[c]
        u = F.col(f"u{own[c]}")
        if c in model.numeric:
            grid = model.numeric[c]
            if grid is None:
                return F.lit(None).cast(kind)
            points = F.array(*(F.lit(float(g)) for g in grid))
            low = F.least(F.floor(u * GRID), F.lit(GRID - 1)).cast("int")
            x = F.element_at(points, low + 1)
            x = x + (u * GRID - low) * (F.element_at(points, low + 2) - x)
            return (F.round(x) if isinstance(kind, T.IntegralType) else x).cast(kind)
        values, shares = model.categorical[c]
        if not shares:
            return F.lit(None).cast(kind)
        return F.element_at(F.array(*map(F.lit, values)), _place(u, np.cumsum(shares)[:-1].tolist()) + 1).cast(kind)

    def kept(c: str) -> Column:
        name = f"{c} missing"
        if name not in own:
            return value(c)
        return F.when(F.col(f"u{own[name]}") <= 1 - model.missing[c], value(c))

    return mixed.select(k.alias(key), *(kept(c).alias(c) for c in [*model.numeric, *model.categorical]))


def parameters(spark: SparkSession, model: Model) -> DataFrame:
    """What was learned, as ``kind, a, b, value``: missing shares, levels' shares, quartiles and hidden correlations."""
    rows = [("missing_share", c, "", float(s)) for c, s in model.missing.items()]
    rows += [("level_share", c, str(v), float(s)) for c, (values, shares) in model.categorical.items() for v, s in zip(values, shares, strict=False)]
    rows += [("quantile", c, f"{q}%", float(g[q * GRID // 100])) for c, g in model.numeric.items() if g for q in (0, 25, 50, 75, 100)]
    rows += [("correlation", a, b, float(model.correlation[i, j])) for i, a in enumerate(model.hidden) for j, b in enumerate(model.hidden) if i < j]
    return spark.createDataFrame(rows, "kind string, a string, b string, value double")
