"""The planted record table ``rec`` built from the driver tables.

One order is one record. Region -> nation plays the role of block -> code
(district -> small area). ``flag`` is a binary target whose missingness depends
on an observed column, ``weight`` a continuous target, ``area`` a hierarchical
code. Truth columns ``true_*`` keep the hidden values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfill.functions.hashing import sql_u, u
from sparkfill.session import forgotten, read_table, shared_path


@dataclass(frozen=True)
class Roles:
    """Column roles of a record table."""
    key: str = "row_id"
    continuous: tuple = ("acct", "n_items", "qty", "price", "site", "weight")
    categorical: tuple = ("district", "area", "seg", "prio", "flag")
    targets: tuple = ("weight", "flag", "area")
    block: str = "district"
    code: str = "area"
    truth_prefix: str = "true_"
    descriptions: dict = field(default_factory=lambda: {
        "row_id": "record key",
        "district": "region of the customer (block)",
        "area": "nation of the customer (code inside the block)",
        "seg": "market segment of the customer",
        "prio": "order priority",
        "acct": "customer account balance",
        "n_items": "number of line items in the order",
        "qty": "total quantity over the line items",
        "price": "total price of the order",
        "site": "site number near ten times the area code",
        "flag": "binary outcome flag",
        "weight": "continuous outcome weight",
    })

    @property
    def features(self) -> tuple:
        return tuple(c for c in self.continuous + self.categorical)

    def is_continuous(self, c: str) -> bool:
        return c in self.continuous


ROLES = Roles()

# numeric feature columns of rec used by model-based operators (strings excluded)
NUMERIC = ("district", "area", "acct", "n_items", "qty", "price", "site", "flag", "weight")


_WRITTEN: dict = {}
#: Rows of a file of the record table at most.
FILE_ROWS = 20_000


def records(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Records with planted nulls and truth columns (see FIXTURES.md section 3).

    The record table is prepared once per session and input folder and written as
    Parquet into the shared checkpoint folder (ETL once, query many); queries read it
    back with column pruning and pushed-down filters."""
    if not materialize:
        return build_records(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _WRITTEN.get(key)
    if path is None:
        path = shared_path(spark, "rec")
        # files of a few rows each, so that readers of a small table are not one task, and none reads very many rows
        build_records(spark, sf_dir).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        forgotten(spark)  # the shuffles of its joins
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table as a lazy plan over the driver tables."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # partial aggregation per map task before the shuffle on l_orderkey
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("qty")))
    b = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
         .select(
             F.col("o_orderkey").alias("row_id"),
             F.col("n_regionkey").alias("district"),
             F.col("n_nationkey").alias("area"),
             F.col("c_mktsegment").alias("seg"),
             F.col("o_orderpriority").alias("prio"),
             F.col("c_acctbal").alias("acct"),
             F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
             F.coalesce("qty", F.lit(0.0)).alias("qty"),
             F.col("o_totalprice").alias("price"),
             F.when(u("flag", F.col("o_orderkey"))
                    < F.lit(0.1) + F.when(F.col("c_mktsegment") == "BUILDING", 0.6).otherwise(0.0),
                    F.lit(1)).otherwise(F.lit(0)).alias("flag"),
         ))
    t = b.select(
        "*",
        F.rint(F.lit(2600.0) + 6 * F.col("qty") - 500 * F.col("flag")
               + 200 * (u("w", F.col("row_id")) - 0.5)).alias("weight"),
        F.rint(F.col("area") * 10 + 8 * u("s", F.col("row_id"))).alias("site"),
    )
    return t.select(
        "row_id", "district",
        F.when(u("ma", F.col("row_id")) < 0.15, F.lit(None).cast("int")).otherwise(F.col("area")).alias("area"),
        "seg", "prio", "acct", "n_items", "qty", "price", "site",
        F.when(u("mf", F.col("row_id"))
               < F.when(F.col("prio") == "1-URGENT", 0.7).otherwise(0.3),
               F.lit(None).cast("int")).otherwise(F.col("flag")).alias("flag"),
        F.when(u("mw", F.col("row_id")) < 0.2, F.lit(None).cast("double")).otherwise(F.col("weight")).alias("weight"),
        F.col("area").alias("true_area"), F.col("flag").alias("true_flag"), F.col("weight").alias("true_weight"),
    )


def missing_view(rec: DataFrame) -> DataFrame:
    """The observed (masked) part of ``rec``."""
    return rec.drop("true_area", "true_flag", "true_weight")


def truth_view(rec: DataFrame) -> DataFrame:
    """The complete truth table keyed by row_id."""
    return rec.select("row_id", "district",
                      F.col("true_area").alias("area"), "seg", "prio", "acct", "n_items", "qty",
                      "price", "site", F.col("true_flag").alias("flag"),
                      F.col("true_weight").alias("weight"))


def _rint(x: str) -> str:
    return f"round_even({x},0)"


REC_CTE = f"""
li AS (SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
rec_b AS (SELECT o_orderkey AS row_id, n_regionkey AS district, n_nationkey AS area, c_mktsegment AS seg,
        o_orderpriority AS prio, c_acctbal AS acct, coalesce(n_items,0) AS n_items, coalesce(qty,0) AS qty,
        o_totalprice AS price,
        CASE WHEN {sql_u('flag', 'o_orderkey')} < 0.1 + CASE WHEN c_mktsegment='BUILDING' THEN 0.6 ELSE 0 END
             THEN 1 ELSE 0 END AS flag
      FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
        LEFT JOIN li ON l_orderkey=o_orderkey),
rec_t AS (SELECT rec_b.*, {_rint(f"2600 + 6*qty - 500*flag + 200*({sql_u('w', 'row_id')}-0.5)")} AS weight,
        {_rint(f"area*10 + 8*{sql_u('s', 'row_id')}")} AS site FROM rec_b),
rec AS (SELECT row_id, district,
  CASE WHEN {sql_u('ma', 'row_id')} < 0.15 THEN NULL ELSE area END AS area,
  seg, prio, acct, n_items, qty, price, site,
  CASE WHEN {sql_u('mf', 'row_id')} < (CASE WHEN prio='1-URGENT' THEN 0.7 ELSE 0.3 END) THEN NULL ELSE flag END AS flag,
  CASE WHEN {sql_u('mw', 'row_id')} < 0.2 THEN NULL ELSE weight END AS weight,
  area AS true_area, flag AS true_flag, weight AS true_weight
FROM rec_t)"""


def with_rec(sql_body: str, *extra_ctes: str) -> str:
    """Prefix a DuckDB query with the ``rec`` CTE (and optional further CTEs)."""
    ctes = ",\n".join((REC_CTE,) + tuple(extra_ctes))
    return f"WITH {ctes}\n{sql_body}"
