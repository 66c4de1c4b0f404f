"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has ``u, v`` of any ordered type; returns ``u, root`` for every node but the roots.

    Large stars hang a node's larger neighbours on its least one, small stars its smaller
    neighbours; a few rounds turn each component into one star around its least node. Each
    round is two grouped minima and joins, of which no node's neighbours are collected,
    and ends in a reliable checkpoint.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, after = None, state(now)
    while before != after:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
        before, after = after, state(now)
    return now.select("u", F.col("v").alias("root"))
