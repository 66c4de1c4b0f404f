"""Operator 9, quality classifier: votes of the nearest labelled documents in a latent space.

A document is a bag of terms: hashed byte trigrams, and the step that each of a few shape
measures falls in (capitals, symbols, words right after themselves, ...), which count more. Terms are
weighted by their rarity among all documents. The weighted vectors of a bounded sample of
labelled documents give a truncated singular value decomposition, and its right vectors
project every document into the latent space. There the exact cosines to all labelled
vectors are one matrix product for a block of documents, and the nearest vote, weighted by
similarity.

What goes to the tasks is bounded by parameters: the projection, the terms' weights, and
the labelled vectors. The sample's bound is ``per_class``; document frequencies are counted
over all documents.

Defined results: a null or empty text has its shape terms alone and is scored by them;
without any labelled document every score is 0.5; a null id is not held out and stays null;
repeated rows get equal scores; an empty table gives an empty table. Columns other than id
and text are neither read nor returned.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.labels import SAMPLE, held_out, labelled_sample
from sparkfill.llm.text import slices

#: Hashed trigrams; the shape terms come after them.
TRIGRAMS = 4096
STEPS = 10  # of each shape measure
_SHAPES = 8
TERMS = TRIGRAMS + _SHAPES * STEPS
_SHAPE_COUNT = 400.0  # a shape term counts as if it occurred so often

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 3 digit, 4 space, 5 other ASCII, 0 longer characters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[c for c in range(128) if not (97 <= c < 123 or 65 <= c < 91 or 48 <= c < 58)]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def _step(share: float) -> int:
    return min(STEPS - 1, int(share * STEPS))


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the terms of a whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    x = data.astype(np.uint32)
    grams = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16) if len(x) > 2 else x[:0]
    out = np.zeros(TERMS, np.float32)
    out[:TRIGRAMS] = np.bincount(grams & np.uint32(TRIGRAMS - 1), minlength=TRIGRAMS)
    kinds = np.bincount(_CLASS[data], minlength=6)
    letters, n = kinds[0] + kinds[1] + kinds[2], max(1, len(data))
    words = (text or "").split()
    lines = [line for line in (text or "").split("\n") if line]
    shapes = (
        kinds[2] / max(1, letters), 4 * kinds[5] / n, 4 * kinds[3] / n,
        len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)),
        len(words) / n * 3, np.log10(1 + len(words)) / 4,
        3 * sum(map(eq, words, words[1:])) / max(1, len(words)),  # a word right after itself
    )
    for k, share in enumerate(shapes):
        out[TRIGRAMS + k * STEPS + _step(float(share))] = _SHAPE_COUNT
    return out


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    def count(batches):
        held, n = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held += term_counts(text) > 0
                n += 1
        terms = np.concatenate([np.flatnonzero(held), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(np.append(held[terms[:-1]], n))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    of = {r.term: r.n for r in rows}
    return np.array([of.get(i, 0) for i in range(TERMS)], np.float64), of.get(-1, 0)


class Model:
    """The latent space, the labelled vectors in it and the rule of the vote."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, frequencies: np.ndarray, n_docs: int, dims: int, neighbours: int, power: float):
        self.rarity = np.log((1 + n_docs) / (1 + frequencies)).astype(np.float32) + np.float32(1)
        self.labels, self.neighbours, self.power = labels.astype(np.float32), neighbours, power
        x = _weighted(counts, self.rarity)
        rng = np.random.default_rng(9)
        dims = max(1, min(dims, *x.shape)) if len(x) else 1
        basis = rng.standard_normal((TERMS, dims + 8)).astype(np.float32)
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            basis = np.linalg.qr(x.T @ (x @ basis))[0] if len(x) else basis
        if len(x):
            _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
            basis = (basis @ v.T)[:, :dims]
        self.project = basis.astype(np.float32)
        self.vectors = self._latent(x)

    def _latent(self, weighted: np.ndarray) -> np.ndarray:
        z = weighted @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self._latent(_weighted(counts, self.rarity)) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        # all that are as near as the k-th, so ties do not depend on the order of the sample
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= least, np.maximum(near, 0) ** self.power + 1e-9, 0)
        return (weight @ self.labels) / weight.sum(axis=1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = SAMPLE, dims: int = 48, neighbours: int = 15, power: float = 12.0) -> Model:
    """``docs`` has ``doc_id, text``; the sample's term counts come to the driver, not its texts."""
    def counts(batches):
        for batch in slices(batches):
            rows = [term_counts(t) for t in batch.column("text").to_pylist()]
            terms = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(terms, pa.list_(pa.int32())),
                 pa.array([r[t] for r, t in zip(rows, terms, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "label", "terms", "counts"])

    sample = labelled_sample(docs, labels, label_col, per_class).mapInArrow(counts, "doc_id long, label int, terms array<int>, counts array<float>").toArrow().sort_by("doc_id")
    x = np.zeros((sample.num_rows, TERMS), np.float32)
    for i, (t, c) in enumerate(zip(sample["terms"], sample["counts"], strict=True)):
        x[i, t.values.to_numpy()] = c.values.to_numpy()
    frequencies, n = document_frequencies(docs)
    return Model(x, sample["label"].to_numpy(), frequencies, n, dims, neighbours, power)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 256, **options) -> DataFrame:
    """Returns ``doc_id, held_out, score`` for every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(own, labels, **options))

    def score(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores = [sent.value.score(np.stack([term_counts(t) for t in texts[i : i + block]])) for i in range(0, len(texts), block)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores).astype(np.float64))], names=["doc_id", "score"])

    scored = own.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
