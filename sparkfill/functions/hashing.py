"""Order-free seeded randomness.

``u(seed, key)`` maps a seed label and a row key to a uniform in [0, 1) through
md5, so the same row gets the same draw whatever the partitioning. The DuckDB
spelling of each expression is kept beside it for the oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(key) -> Column:
    return key if isinstance(key, Column) else F.col(key)


def hash32(seed: str, key) -> Column:
    """Unsigned 32-bit integer from md5('seed:key')."""
    txt = F.concat(F.lit(f"{seed}:"), _key(key).cast("string"))
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


def u(seed: str, key) -> Column:
    """Uniform in [0, 1)."""
    return hash32(seed, key) / F.lit(TWO32)


def u_open(seed: str, key) -> Column:
    """Uniform in (0, 1], safe for log."""
    return (hash32(seed, key) + F.lit(1)) / F.lit(TWO32)


def normal(seed: str, key) -> Column:
    """Standard normal by Box-Muller from two seeded uniforms."""
    u1 = u_open(f"{seed}.1", key)
    u2 = u(f"{seed}.2", key)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def order_key(seed: str, key) -> Column:
    """Sort key for seeded shuffles: the md5 hex string (ties by key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _key(key).cast("string")))


# ---- DuckDB spellings (used by oracle SQL) ----

def sql_hash32(seed: str, key: str) -> str:
    return f"cast('0x'||substr(md5(concat('{seed}:',cast({key} as varchar))),1,8) as bigint)"


def sql_u(seed: str, key: str) -> str:
    return f"({sql_hash32(seed, key)}/4294967296.0::double)"


def sql_u_open(seed: str, key: str) -> str:
    return f"(({sql_hash32(seed, key)}+1)/4294967296.0::double)"


def sql_normal(seed: str, key: str) -> str:
    return (f"(sqrt(-2.0*ln({sql_u_open(seed + '.1', key)}))"
            f"*cos({2 * math.pi!r}*{sql_u(seed + '.2', key)}))")


def sql_order_key(seed: str, key: str) -> str:
    return f"md5(concat('{seed}:',cast({key} as varchar)))"


# Spark SQL text spelling (for selectExpr / spark.sql use)
def spark_sql_u(seed: str, key: str) -> str:
    return (f"(cast(conv(substr(md5(concat('{seed}:',cast({key} as string))),1,8),16,10) as bigint)"
            f"/4294967296.0D)")
