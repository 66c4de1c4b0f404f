"""Session helpers: building a session, shared checkpoint folder, checked broadcast."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Largest side we hint as broadcast after counting it (rows). Everything larger is
# left to the planner (sort-merge / shuffle-hash, AQE may still convert at runtime).
BROADCAST_ROW_LIMIT = 200_000
_PASSING: ContextVar[list | None] = ContextVar("passing", default=None)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "sparkfill") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only when it is unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = os.environ.get("SPARKFILL_CHECKPOINT_DIR") or f"/tmp/sparkfill-ckpt-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:10]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Unlike a checkpoint it forgets the plan's size estimates,
    which grow without end where a loop joins its own results."""
    path = shared_path(df.sparkSession, name)
    if (passing_ := _PASSING.get()) is not None:
        passing_.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forgotten(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that were written by :func:`written` and are not read any more, and lets Spark's cleaner find the shuffles
    and checkpoints that nobody refers to; on its own it waits until the driver is short of memory."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is :func:`written` within is deleted at the end; results that go on must not read it, so they are kept by a checkpoint."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        paths = _PASSING.get()
        _PASSING.reset(token)
        forgotten(spark, *paths)


def side_by_side(spark: SparkSession, steps: Sequence[Callable]) -> list:
    """What ``steps`` return. They run at once, so that the small jobs of one don't wait for those of another."""
    with ThreadPoolExecutor(max(len(steps), 1)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """Bounded check: reads at most ``limit + 1`` rows."""
    return df.limit(limit + 1).count() <= limit


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint broadcast only after proving the side holds at most ``limit`` rows."""
    return F.broadcast(df) if row_count_at_most(df, limit) else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
