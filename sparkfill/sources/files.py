"""Sources and sinks (A1-A9): CSV/Parquet/JSON-lines in and out, run traces, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkfill.functions.scalars import NUMERIC_TYPES


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, null_values: Sequence[str] = ("",)) -> DataFrame:
    """Read CSV with header. Give a schema in production; ``inferSchema`` only for profiling.

    ``NaN`` cells in double columns become SQL null (pandas treats both as missing)."""
    r = spark.read.option("header", header).option("nanValue", "NaN").option("mode", "PERMISSIVE")
    if null_values:
        r = r.option("nullValue", null_values[0])
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    fixes = {c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixes) if fixes else df


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """File paths of a folder and the folders in it, through the binaryFile source (content column pruned)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(folder).select("path").collect())
    return sorted(r["path"] for r in files)


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.csv",
                schemas: Mapping[str, StructType] | None = None) -> dict[str, DataFrame]:
    """Every CSV of a folder as a named table (A2): a file gives its stem as name, a folder of
    part files, as Spark writes them, its own."""
    own = folder.rstrip("/").split("/")[-1]
    tables: dict[str, list[str]] = {}
    for p in list_files(spark, folder, pattern):
        *_, parent, name = p.split("/")
        tables.setdefault(name.rsplit(".", 1)[0] if parent == own else parent, []).append(p)
    return {name: scan_csv(spark, paths, (schemas or {}).get(name)) for name, paths in sorted(tables.items())}


def detect_metadata(df: DataFrame, key: str | None = None, max_categories: int = 30,
                    exact: bool = True) -> DataFrame:
    """Semantic type per column (A3): (column, sdtype, n_rows, n_null, n_distinct).

    id = the key column; categorical = string, or numeric with at most ``max_categories``
    distinct values; boolean = numeric with at most two distinct values; else numerical.
    Distinct counts come from one shuffle of (column, value) pairs, not one job per column."""
    cols = df.columns
    types = dict(df.dtypes)
    if exact:
        lv = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
        nd = lv.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("one")) \
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    else:
        # HyperLogLog sketches for every column in one aggregate (no shuffle of distinct values)
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        nd = one.unpivot([], cols, "column", "n_distinct")
    cnt = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(F.col(c)).alias(c) for c in cols])
    present = cnt.unpivot(["n_rows"], cols, "column", "n_present")
    spark = df.sparkSession
    tdf = spark.createDataFrame([(c, types[c] in NUMERIC_TYPES) for c in cols], "column string, numeric boolean")
    m = present.join(F.broadcast(tdf), "column").join(nd, "column", "left").fillna(0, ["n_distinct"])
    sd = (F.when(F.col("column") == F.lit(key), "id")
          .when(~F.col("numeric"), "categorical")
          .when(F.col("n_distinct") <= 2, "boolean")
          .when(F.col("n_distinct") <= max_categories, "categorical")
          .otherwise("numerical"))
    return m.select("column", sd.alias("sdtype"), "n_rows",
                    (F.col("n_rows") - F.col("n_present")).alias("n_null"), "n_distinct")


def assert_unique(df: DataFrame, key: str) -> None:
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"key {key} is not unique")


def scan_keyed(df: DataFrame, stored_key: str, key: str = "row_id", check: bool = True) -> DataFrame:
    """Make a stored column the row key (A4); the key must be unique."""
    out = df.withColumnRenamed(stored_key, key)
    if check:
        assert_unique(out, key)
    return out


def sink_table(df: DataFrame, path: str, partition_cols: Sequence[str] = (), fmt: str = "parquet",
               mode: str = "overwrite") -> str:
    """Write a result table partitioned by run parameters (A5)."""
    w = df.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_trace(tables: Mapping[str, DataFrame], base: str, partition_cols: Sequence[str] = ()) -> dict[str, str]:
    """Store the nested run trace as flat Parquet tables."""
    out = {}
    for name, t in tables.items():
        p = f"{base.rstrip('/')}/{name}"
        pcs = [c for c in partition_cols if c in t.columns]
        sink_table(t, p, pcs)
        out[name] = p
    return out


def read_trace(spark: SparkSession, base: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}") for n in names}


def sink_jsonl(df: DataFrame, path: str, partition_cols: Sequence[str] = (), mode: str = "overwrite") -> str:
    """One JSON object per line (A7); partition columns stay out of the object."""
    body = [c for c in df.columns if c not in partition_cols]
    out = df.select(*partition_cols, F.to_json(F.struct(*body)).alias("value"))
    w = out.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.text(path)
    return path


def reject_trailer_rows(df: DataFrame, domains: Mapping[str, Sequence]) -> tuple[DataFrame, DataFrame]:
    """Keep records: drop all-null rows and rows with a categorical cell outside its domain.

    Returns (kept, rejects); a null categorical cell is a missing value, not a reject."""
    not_empty = F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull()
    ok = not_empty
    for c, dom in domains.items():
        ok = ok & (F.col(c).isNull() | F.col(c).isin(list(dom)))
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)
