"""Operator 12, vector code compression: codebooks for the parts of vectors, over Hilbert-sorted flat blocks.

Vectors of integers are cut into equal parts. As they are read, some thousands of vectors make a
chunk; in a chunk, the points of each part are sorted along a Hilbert curve and cut into flat blocks
of ``BLOCK`` points. A block stores its least and largest components (a box), the sums of its
components, and its points. Chunks are written once to the shared folder and reread each round.

In a round, the least and the largest squared distance from a block's box to each codebook entry are
integers computed from the box alone. An entry whose least is above some other entry's largest is
nowhere nearest in the block; the others are its shortlist. A block with one entry on its shortlist
adds its stored sums and count to that entry, and its points are not looked at. For the rest a
small kernel computes the exact squared distances of the block's points to the shortlist, in 32-bit
integers where they fit. Ties go to the lower index, as equal bounds stay on the list.

Nothing is shuffled but the sums of each round (``parts x entries x width`` numbers, added up
in the tasks first), and as many reach the driver, whatever the input.

Defined results: vectors that are null or hold null or non-finite components are left out, and
those with an integer beyond 2^26 (see ``vectors.quantised``); the width comes from the vector of
the smallest id whose length is a multiple of ``parts``, and vectors of other lengths are left out;
a null id is coded like any other, but never starts an entry; repeated rows count as rows of their
own, and so may start entries of their own, equal ids by their components; fewer vectors with an
id than ``entries`` give smaller codebooks; nulls among labels make one group; an empty table (or one
without such vectors) gives an empty table. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.vectors import LIMIT, first_by, floor_means, key_limit, matrix, quantised, summed
from sparkfill.session import broadcast_checked, shared_path

#: Points of a block.
BLOCK = 16
#: Vectors of a chunk (at most 65,536).
CHUNK = 16384
#: Distances that the kernel holds at once.
KERNEL = 1 << 21
#: Shares of the rows of one label, where there are too many labels to broadcast.
SALT = 64

_CHUNK = "n int, rows binary, places binary, points binary, low binary, high binary, sums binary"
_CHUNKS = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "places", "points", "low", "high", "sums"))])


def hilbert_order(points: np.ndarray, bits: int = 8) -> np.ndarray:
    """The rows of ``points`` sorted by their place on a Hilbert curve through their box.

    Bit by bit from the highest: the curve visits the cells of a cube in Gray code, and each cell's own
    curve is turned by exchanging or inverting lower bits, as the bits above demand. At most 62
    bits make a place, so wide points are placed by their first components.
    """
    used = min(points.shape[1], 31)
    bits = max(1, min(bits, 62 // used))
    low = points[:, :used].min(axis=0)
    span = np.maximum(points[:, :used].max(axis=0) - low, 1)
    cells = ((points[:, :used] - low) * ((1 << bits) - 1) // span).astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(used):
            up = (cells[i] >> level & 1).astype(bool)
            swapped = np.where(up, 0, (cells[0] ^ cells[i]) & below)
            cells[0] ^= np.where(up, below, swapped)
            cells[i] ^= swapped
    for i in range(1, used):
        cells[i] ^= cells[i - 1]
    turn = np.zeros_like(cells[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(cells[used - 1] >> level & 1, (1 << level) - 1, 0)
    place = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(used):
            place = place << 1 | ((cells[i] ^ turn) >> level & 1)
    return np.argsort(place, kind="stable")


class Blocks:
    """The blocks of one part of a chunk. The last block is filled up with copies of its last point, which don't count."""

    def __init__(self, places, points, low, high, sums):
        self.places, self.points, self.low, self.high, self.sums = places, points, low, high, sums
        self.counts = np.full(len(low), BLOCK)
        if len(low):
            self.counts[-1] = len(places) - BLOCK * (len(low) - 1)

    @classmethod
    def of(cls, points: np.ndarray) -> Blocks:
        places = hilbert_order(points)
        own = points[places]
        spare = -len(own) % BLOCK
        cut = np.concatenate([own, np.repeat(own[-1:], spare, axis=0)]).reshape(-1, BLOCK, points.shape[1])
        sums = cut.sum(axis=1)
        sums[-1] -= spare * own[-1]
        return cls(places, own, cut.min(axis=1), cut.max(axis=1), sums)

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """For each block and entry, whether the entry may be nearest to one of the block's points."""
        under, over = self.low[:, None, :] - book, book - self.high[:, None, :]
        gap = np.maximum(np.maximum(under, over), 0)
        reach = np.maximum(-over, -under)
        least, most = np.einsum("bei,bei->be", gap, gap), np.einsum("bei,bei->be", reach, reach)
        return least <= most.min(axis=1, keepdims=True)

    def nearest(self, book: np.ndarray, blocks: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest listed entry, for each point of the given blocks."""
        width = self.points.shape[1]
        spare = BLOCK * len(self.low) - len(self.points)
        cut = np.concatenate([self.points, np.repeat(self.points[-1:], spare, axis=0)]).reshape(-1, BLOCK, width)
        largest = int(max(-self.low.min(), self.high.max(), -book.min(), book.max(), 1))
        small = (width * (2 * largest) ** 2 + 1) * len(book) < 1 << 31
        if largest > key_limit(len(book), width):
            raise OverflowError(f"components beyond {key_limit(len(book), width)} have no 64-bit keys with {len(book)} entries")
        kind = np.int32 if small else np.int64
        cut, book = cut.astype(kind), book.astype(kind)
        out = np.empty((len(blocks), BLOCK), np.int64)
        per = listed[blocks].sum(axis=1)
        cuts = np.cumsum(per) * BLOCK // KERNEL
        for run in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(cuts)) + 1):
            if not len(run):
                continue
            b, e = np.nonzero(listed[blocks[run]])
            d = cut[blocks[run][b]] - book[e][:, None, :]
            key = np.einsum("pki,pki->pk", d, d) * kind(len(book)) + e[:, None].astype(kind)
            first = np.concatenate([[0], np.cumsum(per[run])[:-1]])
            out[run] = np.minimum.reduceat(key, first, axis=0)
        return out % len(book), out // len(book)

    def add_to(self, sums: np.ndarray, counts: np.ndarray, book: np.ndarray) -> int:
        """Adds every point to its nearest entry's sum and count; returns how many distances were computed."""
        listed = self.shortlists(book)
        per = listed.sum(axis=1)
        sure = np.flatnonzero(per == 1)
        entry = np.argmax(listed[sure], axis=1)
        np.add.at(sums, entry, self.sums[sure])
        np.add.at(counts, entry, self.counts[sure])
        rest = np.flatnonzero(per > 1)
        if len(rest):
            entry, _ = self.nearest(book, rest, listed)
            at = rest[:, None] * BLOCK + np.arange(BLOCK)
            real = at < len(self.points)
            entry, at = entry[real], at[real]
            for i in range(sums.shape[1]):  # sums of integers of less than 53 bits are exact as doubles
                part = self.points[at, i]
                if len(part) * int(np.abs(part).max(initial=0)) < 1 << 53:
                    sums[:, i] += np.bincount(entry, part, minlength=len(book)).astype(np.int64)
                else:
                    np.add.at(sums[:, i], entry, part)
            counts += np.bincount(entry, minlength=len(book))
        return int(per[rest].sum()) * BLOCK

    def coded(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every point, in the chunk's order of rows."""
        entry, error = self.nearest(book, np.arange(len(self.low)), self.shortlists(book))
        n = len(self.places)
        out, errors = np.empty(n, np.int64), np.empty(n, np.int64)
        out[self.places], errors[self.places] = entry.ravel()[:n], error.ravel()[:n]
        return out, errors


def _chunks(parts: int, width: int):
    def row(x: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        made = [Blocks.of(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p in range(parts)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        values = [[len(x)], [sink.getvalue().to_pybytes()], [b"".join(b.places.astype("<u2").tobytes() for b in made)]]
        values += [[b"".join(getattr(b, c).astype("<i8" if c == "sums" else "<i4").tobytes() for b in made)] for c in ("points", "low", "high", "sums")]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _CHUNKS, strict=True)], schema=_CHUNKS)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = pa.concat_batches(held)
        return row(matrix(some.column("q"), parts * width), some.drop_columns(["q"]))

    def make(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, CHUNK - n)
                held.append(some)
                at, n = at + some.num_rows, n + some.num_rows
                if n == CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return make


def _read(batches, parts: int, width: int):
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            cols = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(("places", "points", "low", "high", "sums"), ("<u2", "<i4", "<i4", "<i4", "<i8"), strict=True)]
            places, points, low, high, sums = (c.reshape(parts, -1).astype(np.int64) for c in cols)
            blocks = [Blocks(places[p], points[p].reshape(-1, width), *(c[p].reshape(-1, width) for c in (low, high, sums))) for p in range(parts)]
            yield n, batch.column("rows")[i].as_buffer(), blocks


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def add(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, _, blocks in _read(batches, parts, width):
            for p, b in enumerate(blocks):
                b.add_to(sums[p], counts[p], books[p])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(counts.ravel()[used]), pa.array(sums.reshape(-1, width)[used].tolist(), pa.list_(pa.int64()))],
            names=["grp", "n", "total"])

    return add


def _codes(books: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def code(batches):
        for n, rows, blocks in _read(batches, parts, width):
            found = [b.coded(books[p]) for p, b in enumerate(blocks)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            own = pa.ipc.open_stream(rows).read_next_batch()
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=[*names, "code", "error"])

    return code


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2, id_col: str = "vec_id",
                     vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """``vec_id``, the columns ``keep``, ``code`` and ``error`` of every kept vector, and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    kept = quantised(vectors, scale, id_col, vector_col, keep)
    fits = kept.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    lead = first_by(fits, 1, F.col("vec_id"))
    dims = len(lead[0]) if lead else (fits.select(F.max(F.size("q")).alias("d")).first().d or 0)
    kept = fits.where(F.size("q") == dims)
    names = [f.name for f in kept.drop("q").schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("q").schema)
    starts = first_by(kept, entries, F.col("vec_id"))
    if not starts:
        return spark.createDataFrame([], f"{kinds}, code string, error long"), []
    width = dims // parts
    if key_limit(entries, width) < LIMIT:
        kept = kept.where(F.forall("q", lambda c: F.abs(c) <= key_limit(entries, width)))
    books = np.array(starts, np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    path = shared_path(spark, "blocks")
    kept.mapInArrow(_chunks(parts, width), _CHUNK).write.parquet(path)
    chunks = spark.read.schema(_CHUNK).parquet(path)
    for _ in range(rounds):
        sums, counts = summed(chunks.mapInArrow(_sums(books), "grp int, n long, total array<long>"), parts * books.shape[1], width)
        books = floor_means(sums.reshape(books.shape), counts.reshape(books.shape[:2]), books)
    out = shared_path(spark, "codes")
    chunks.mapInArrow(_codes(books, names), f"{kinds}, code string, error long").write.parquet(out)
    return spark.read.parquet(out), books.tolist()


def _per_label(found: DataFrame, label: Column) -> DataFrame:
    """``found`` with ``label_error``: labels are added up first; rows of one label are then dealt to ``SALT`` shares."""
    own = found.withColumn("share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")).withColumn("of", label)
    sums = own.groupBy("of").agg(F.sum("error").alias("label_error")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sums = sums.withColumnsRenamed({"of": "s_of", "share": "s_share"})
    return own.join(broadcast_checked(sums), F.col("of").eqNullSafe(F.col("s_of")) & (F.col("share") == F.col("s_share")))


def digest(vectors: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    found, books = compress_vectors(vectors, keep=(label_col,), **options)
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return _per_label(found, F.col(label_col)).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
