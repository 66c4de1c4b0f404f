"""Seeded, order-free sampling (E7-E11, I19, I20; S5, S16).

Rows are ordered by ``md5(seed:key)`` with the key as tie-break. Taking the
first n rows of that order uses radix selection: count rows per hex prefix of
the hash (at most 65,536 counts per group reach the driver), keep every prefix
below the one that holds the n-th row, and descend into that one prefix only.
No global sort, no single-task window over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfill.functions.hashing import hash32, order_key
from sparkfill.session import cut_lineage

PREFIX = 4                 # hex digits per radix level (65,536 buckets)
FINAL_ROWS = 1_000_000     # a boundary bucket this small is ranked in one window


def _first_n_in_hash_order(df: DataFrame, hcol: str, key: str, quotas: Mapping, group: str | None,
                           level: int = 0) -> DataFrame:
    """Rows of ``df`` among the first quotas[g] rows of their group in (hcol, key) order."""
    gcol = F.col(group) if group else F.lit(0)
    pre = F.substring(F.col(hcol), level * PREFIX + 1, PREFIX)
    counts = df.groupBy(gcol.alias("__g"), pre.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).collect()
    by_g: dict = {}
    for r in counts:
        by_g.setdefault(r["__g"], []).append((r["__p"], r["__n"]))
    cond = F.lit(False)
    boundary = []  # (group, prefix, rows still needed, rows in prefix)
    for g, lst in by_g.items():
        need = int(quotas.get(g, 0))
        if need <= 0:
            continue
        acc, cut = 0, None
        for p, n in sorted(lst):
            if acc + n <= need:
                acc += n
                continue
            cut = p
            if need - acc > 0:
                boundary.append((g, p, need - acc, n))
            break
        gm = (gcol == F.lit(g)) if group else F.lit(True)
        cond = cond | (gm & (F.lit(True) if cut is None else (pre < F.lit(cut))))
    taken = df.where(cond)
    for g, p, rem, n in boundary:
        gm = (gcol == F.lit(g)) if group else F.lit(True)
        sub = df.where(gm & (pre == F.lit(p)))
        if n <= FINAL_ROWS or (level + 1) * PREFIX >= 32:
            # bounded: at most FINAL_ROWS rows share this hash prefix
            w = Window.orderBy(hcol, key)
            part = sub.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= rem).drop("__rn")
        else:
            part = _first_n_in_hash_order(sub, hcol, key, {g: rem}, group, level + 1)
        taken = taken.unionByName(part)
    return taken


def sample_exact_n(df: DataFrame, n: int, seed: str, key: str = "row_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, seeded and order-free."""
    d = df.withColumn("__h", order_key(seed, key))
    return _first_n_in_hash_order(d, "__h", key, {0: n}, None).drop("__h")


def sample_exact_per_group(df: DataFrame, group: str, quotas: Mapping, seed: str, key: str = "row_id") -> DataFrame:
    """Exactly quotas[g] rows of each group g."""
    d = df.withColumn("__h", order_key(seed, key))
    return _first_n_in_hash_order(d, "__h", key, quotas, group).drop("__h")


def allocate(sizes: Mapping, n: int) -> dict:
    """Proportional allocation, floor then largest remainder, ties by stratum."""
    total = sum(sizes.values())
    if total == 0:
        return {s: 0 for s in sizes}
    n = min(n, total)
    raw = {s: n * c / total for s, c in sizes.items()}
    out = {s: math.floor(v) for s, v in raw.items()}
    left = n - sum(out.values())
    order = sorted(sizes, key=lambda s: (-(raw[s] - out[s]), s))
    for s in order[:left]:
        out[s] += 1
    return out


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: str, key: str = "row_id") -> DataFrame:
    """Draw n rows proportionally to stratum sizes."""
    sizes = {r[stratum]: r["n"] for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    return sample_exact_per_group(df, stratum, allocate(sizes, n), seed, key)


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: str = "split42", key: str = "row_id",
                     out: str = "is_test") -> DataFrame:
    """Mark the first ceil(test_size * n) rows in hash order as test."""
    n = df.count()
    k = math.ceil(test_size * n)
    test = sample_exact_n(df.select(key), k, seed, key).withColumn(out, F.lit(1))
    return df.join(test, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def undersample(df: DataFrame, cls: str, seed: str = "under", key: str = "row_id") -> DataFrame:
    """Cut every class to the size of the smallest class."""
    sizes = {r[cls]: r["n"] for r in df.where(F.col(cls).isNotNull()).groupBy(cls)
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.limit(0)
    m = min(sizes.values())
    return sample_exact_per_group(df.where(F.col(cls).isNotNull()), cls, {c: m for c in sizes}, seed, key)


def kfold_assign(df: DataFrame, k: int, seed: str = "fold", key: str = "row_id", out: str = "fold") -> DataFrame:
    """Shuffled k-fold labels by hash (E11): equal fold sizes in expectation, no sort."""
    return df.withColumn(out, F.pmod(hash32(seed, key), F.lit(k)).cast("int"))


def mask_random(df: DataFrame, target: str, seed: str, key: str = "row_id", min_rate: float = 0.1,
                rate: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Hide max(min_rate, observed missing rate) of the known target values.

    Returns (masked table, hidden keys). ``rate`` overrides the observed rate."""
    stats = df.agg(F.avg(F.col(target).isNull().cast("double")).alias("r"), F.count(target).alias("k")).first()
    r = max(min_rate, (stats["r"] or 0.0) if rate is None else rate)
    n_hide = min(int(r * stats["k"]), stats["k"])
    # joined wherever the masked table or the hidden keys are read
    hidden = cut_lineage(sample_exact_n(df.where(F.col(target).isNotNull()).select(key), n_hide, seed, key))
    t = dict(df.dtypes)[target]
    masked = (df.join(hidden.withColumn("__hit", F.lit(True)), key, "left")
                .withColumn(target, F.when(F.col("__hit"), F.lit(None).cast(t)).otherwise(F.col(target)))
                .drop("__hit"))
    return masked, hidden


def mask_to_percent(df: DataFrame, percents: Mapping[str, float], seed: str = "pct",
                    key: str = "row_id") -> DataFrame:
    """Per column, hide values until ``pct`` percent of rows are missing."""
    stats = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in percents]).first()
    n = stats["__n"]
    out = df
    for c, pct in percents.items():
        already = n - stats[c]
        need = max(0, int(pct * n / 100) - already)
        if need == 0:
            continue
        hidden = sample_exact_n(df.where(F.col(c).isNotNull()).select(key), need, f"{seed}:{c}", key)
        t = dict(df.dtypes)[c]
        out = (out.join(hidden.withColumn(f"__hit_{c}", F.lit(True)), key, "left")
                  .withColumn(c, F.when(F.col(f"__hit_{c}"), F.lit(None).cast(t)).otherwise(F.col(c)))
                  .drop(f"__hit_{c}"))
    return out

