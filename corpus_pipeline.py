"""From ``documents`` to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its
result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfill.llm import decontaminate, jaccard, packing, secrets, toxicity
from sparkfill.session import read_table, shared_path


def leave_out_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the network scores 0.5 or more."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word n-grams with a similarity of 0.8 or more link."""
    return jaccard.keep_one(docs)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[secret]`` in place of every secret found."""
    return secrets.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, dealt into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", leave_out_toxic),
    ("near duplicates", keep_one_of_near_copies),
    ("decontamination", leave_out_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Models and tokenizers are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
