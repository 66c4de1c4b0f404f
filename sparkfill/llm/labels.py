"""What the two classifiers share: folds, and a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a model is fitted on.
SAMPLE = 1500


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = SAMPLE, longest: int | None = None) -> DataFrame:
    """``doc_id, text, label`` of up to ``per_class`` documents a class that are not held out.

    Those of the least hash of their id are taken, so the choice does not depend on order;
    ``longest`` leaves out longer texts (in characters). ``docs`` has ``doc_id, text``.
    The chosen ids are few by construction, so they are broadcast to the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    if longest is not None:
        known = known.join(docs.where(F.char_length("text") <= longest).select("doc_id"), "doc_id", "left_semi")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(chosen, "doc_id").dropDuplicates(["doc_id"])
