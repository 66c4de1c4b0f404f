"""Operator 3, n-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

1. Each document's set of word n-grams gives a MinHash signature, cut into bands whose number
   and rows are chosen for a target recall at the threshold. Documents of equal sets are
   one from here on (a representative with a number of copies).
2. Band hashes are shuffled; a bucket is the representatives that share one. Buckets with
   the same members as another are left out, since a pair is looked at only in the first
   band in which it agrees.
3. Large buckets are dealt into blocks, and every two blocks of a bucket meet in a row group
   of bounded size. There all pairs are compared on their full sets, as one product of
   0/1 matrices; out come, for each document, its number of links and one edge towards
   the least of its links, never the pairs themselves.
4. Connected components of the edges are the classes.

No pair with a similarity at the threshold or above is lost but by the MinHash itself
(``recall``), whatever the size of its bucket.

Defined results: null and empty texts have an empty set, link with each other as copies and
with nothing else; a text of fewer words than ``n`` is one n-gram of all its words; rows
repeated are copies; a class is named by its least id that is not null (null if there is
none); an empty table gives an empty table. Other columns are neither read nor returned by
``near_duplicates``; ``keep_one`` returns whole rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.graph import connected_components
from sparkfill.llm.text import hashed_words, mix, ngram_hashes, slices, space_words, text_key, word_hashes
from sparkfill.session import shared_path

#: Representatives in a block; two blocks at most meet in a task's memory.
BLOCK = 128
_COLUMNS = 8192  # n-grams in one matrix product


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """The most rows a band, and bands for them, that find a pair at the threshold with ``recall`` in ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-max(threshold**rows, 1e-12)))
        if best is None or bands * rows <= most:
            best = (bands, rows)
    return best


def gram_set(text: str | None, n: int) -> np.ndarray:
    """The distinct hashes of the text's word n-grams, sorted."""
    words = word_hashes(space_words(text))
    return np.unique(ngram_hashes(words, min(n, len(words)) or 1))


def _signer(n: int, bands: int, rows: int):
    seeds = np.random.default_rng(20).integers(1, 1 << 63, (2, bands * rows), dtype=np.uint64)
    times, plus = seeds[0] | np.uint64(1), seeds[1]
    names = ["doc_id", "text_key", "fp", "bands"]

    def sign(batches):
        for batch in slices(batches):
            fps, out = [], []
            flat, begins = hashed_words(batch.column("text").to_pylist())
            for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
                grams = np.unique(ngram_hashes(flat[a:b], min(n, b - a) or 1))
                # order-free digest of the set, 128 bits
                digest = np.array([len(grams), (mix(grams).sum() if len(grams) else 0), np.bitwise_xor.reduce(mix(grams + np.uint64(1))) if len(grams) else 0], np.uint64)
                fps.append(mix(digest[1:] + digest[0]).tobytes())
                if not len(grams):
                    out.append([])
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for part in np.array_split(grams, -(-len(grams) // 512)):
                    np.minimum(least, (part[:, None] * times + plus).min(axis=0), out=least)
                key = np.arange(bands, dtype=np.uint64)
                for row in least.reshape(bands, rows).T:
                    key = mix(key * np.uint64(31) + row)
                out.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(fps, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=names)

    return sign


def _compare(rows: list[tuple], band: int, n: int, threshold: float):
    """Links of one row group: ``(fp, root, links)`` for each representative that has any.

    ``rows``: (fp, block, bands, copies, text); pairs of a group of two blocks are those across.
    """
    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)  # a repeated row of the corpus came twice
    rows = [seen[fp] for fp in sorted(seen)]
    m = len(rows)
    if m < 2:
        return
    blocks, copies = np.array([r[1] for r in rows]), np.array([r[3] for r in rows], np.int64)
    bands = np.array([r[2] for r in rows], np.int64)
    sets = [gram_set(r[4], n) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    doc = np.repeat(np.arange(m), sizes)
    keep = shared[inverse]
    doc, col = doc[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    common = np.zeros((m, m), np.float64)
    for start in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(col, [start, start + _COLUMNS])
        matrix = np.zeros((m, min(_COLUMNS, int(shared.sum()) - start)), np.float32)
        matrix[doc[a:b], col[a:b] - start] = 1
        common += matrix @ matrix.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    for i in np.flatnonzero(linked.any(axis=1)):  # each pair belongs to the first band in which it agrees
        others = np.flatnonzero(linked[i])
        linked[i, others] = np.argmax(bands[others] == bands[i], axis=1) == band
    root = np.arange(m)
    while True:  # the least member of each connected part
        near = np.where(linked, root[None, :], m).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            break
        root = new
    links = linked @ copies
    for i in np.flatnonzero(links):
        yield rows[i][0], rows[root[i]][0], int(links[i])


def _verifier(n: int, threshold: float):
    schema = pa.schema([("fp", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])
    key_names = ("band", "bucket", "left", "right")
    names = ("fp", "block", "bands", "copies", "text")

    def verify(batches):
        held, key, out = [], None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key_names), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            for k, row in zip(keys, rows, strict=True):
                if k != key:
                    out.extend(_compare(held, key[0], n, threshold) if held else ())
                    held, key = [], k
                held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        out.extend(_compare(held, key[0], n, threshold) if held else ())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return verify


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows ``doc_id, text_key, fp``, and for each set ``fp, copies, links, who``; ``docs`` has ``doc_id, text``."""
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    signed = _written(keyed.mapInArrow(_signer(n, bands, rows), "doc_id long, text_key long, fp binary, bands array<long>"), "minhash")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")  # nulls last
    sets = _written(signed.groupBy("fp").agg(F.count("fp").alias("copies"), F.min(who).alias("who"), F.first("bands").alias("bands")), "sets")

    entries = sets.select("fp", F.posexplode("bands").alias("band", "bucket"))
    # distinct buckets of two or more; equal memberships by an order-free digest
    found = entries.groupBy("band", "bucket").agg(
        F.count("fp").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("size > 1")
    kept = found.groupBy("size", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
    kept = kept.select("b.band", "b.bucket", F.ceil(F.col("size") / block).cast("int").alias("n_blocks"))
    members = entries.join(kept, ["band", "bucket"])
    members = members.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n_blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = members.select("fp", "band", "bucket", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    members = _written(members, "members")

    wanted = members.select("fp").distinct().join(sets, "fp")
    wanted = wanted.select("fp", "bands", "copies", F.col("who.doc_id").alias("w_id"), F.col("who.text_key").alias("w_key"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("fp", "bands", "copies", "text")
    groups = members.join(texts, "fp").repartition("band", "bucket", "left", "right").sortWithinPartitions("band", "bucket", "left", "right")
    linked = _written(groups.mapInArrow(_verifier(n, threshold), "fp binary, root binary, links long"), "links")

    roots = connected_components(linked.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    sets = sets.drop("bands").join(links, "fp", "left").join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    sets = sets.select("fp", "copies", F.coalesce("links", F.lit(0)).alias("links"), "who", F.coalesce("root", "fp").alias("root"))
    least = sets.groupBy("root").agg(F.min("who").alias("of_class"))
    return signed.drop("bands"), sets.join(least, "root")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """One row a document: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the least id of all that chains of links reach; ``n_links`` counts the
    other documents with a similarity of ``threshold`` or more, copies included, and
    ``n_copies`` those with the same set of n-grams.
    """
    signed, sets = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, threshold, recall, block)
    sets = sets.select("fp", "copies", "links", F.col("of_class.doc_id").alias("class_id"))
    return signed.select("doc_id", "fp").join(sets, "fp").select(
        "doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK) -> DataFrame:
    """``docs`` with one whole row of each class, that of its least id."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    _, sets = _classes(own, n, threshold, recall, block)
    stay = sets.select("of_class.doc_id", "of_class.text_key").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), text_key(F.col(text_col)).alias("k"))
    same: Column = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))
    # rows repeated whole or in part meet under one key; one stays
    return whole.join(stay, same, "left_semi").groupBy("i", "k").agg(F.first("row").alias("row")).select("row.*")
