"""Helpers shared by the operators: bounded memos, word splitting, n-gram hashes, Arrow batches.

Functions here run inside Python tasks on one Arrow batch at a time; nothing is kept
between tasks but memos of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a memo may hold, about; beyond it the memo starts anew.
MEMO_BYTES = 32 << 20
#: Keys longer than this many characters are not kept.
MEMO_KEY = 64
#: Bytes of an entry besides its key's and value's own.
_ENTRY = 200

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Memo(dict):
    """``memo[key]`` computes ``make(key)`` once; long keys are not kept, and a full memo is emptied."""

    def __init__(self, make: Callable, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_KEY:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        size = _ENTRY + len(key) + (len(value) if hasattr(value, "__len__") else 0)
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size


_OF_WORKER: dict = {}


def of_worker(name, make: Callable):
    """``make()``, kept by this Python worker until it is asked for something of another name.

    A worker lives on from task to task, so it holds the memos of one operator at a time.
    """
    if name not in _OF_WORKER:
        _OF_WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _OF_WORKER[name] = make()
    return _OF_WORKER[name]


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return text.encode().split() if text else []


#: ASCII letters to lower case, other ASCII but digits to a space; bytes of longer characters stay.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal, well spread outputs."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = of_worker("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, 2 * MEMO_BYTES))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after another, and where each text's begin.

    Each distinct word of the batch is hashed once."""
    words, which, begins = distinct([pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.string()))])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))[which]  # white space at an end leaves an empty string
    return hashes[which[real]], np.concatenate([[0], np.cumsum(real)])[begins]


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` consecutive hashes; none if there are fewer than ``n``."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m] + np.uint64(seed)
    for j in range(1, n):
        out = out * _ODD + hashes[j : j + m]
    return mix(out)


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``most`` bytes of ``column`` (or field of the first one), or one row."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            col = batch.column(column) if column in batch.schema.names else batch.column(0).field(column)
            lengths = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(lengths.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def distinct(lists: list[pa.ListArray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct strings of some lists, the number of each string's own, and where each list begins."""
    values = pa.concat_arrays([pa.array([], pa.string()), *(x.flatten() for x in lists)]).dictionary_encode()
    lengths = np.concatenate([np.zeros(1, np.int64), *(np.asarray(pc.list_value_length(x)).astype(np.int64) for x in lists)])
    return values.dictionary.to_pylist(), np.asarray(values.indices).astype(np.int64), np.cumsum(lengths)


def runs(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[starts[i] : starts[i + 1]]`` for each ``i`` of ``which``, one after another, and where each begins."""
    sizes = np.diff(starts)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], sizes)], ends


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def text_key(text: Column) -> Column:
    """Tells apart rows of one id with different texts; equal rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def running_total(df: DataFrame, part: str, order: str, value: str, wide: int = 1024) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows before, by ``(part, order)``.

    Three levels: rows of a part, parts of a run of ``wide`` parts, and runs. So no task sees more
    than one part's rows, ``wide`` parts, or one row for each run.
    """
    run = F.floor(F.col(part) / wide)
    parts = df.groupBy(part).agg(F.sum(value).alias("__sum")).withColumn("__run", run)
    runs = parts.groupBy("__run").agg(F.sum("__sum").alias("__all"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__r", F.coalesce(F.sum("__all").over(earlier(Window.orderBy("__run"))), F.lit(0))).drop("__all")
    parts = parts.withColumn("__p", F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy("__run").orderBy(part))), F.lit(0)))
    base = parts.join(runs, "__run").select(part, (F.col("__p") + F.col("__r")).alias("__base"))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(part).orderBy(order))), F.lit(0))
    return df.withColumn("__own", own).join(base, part).withColumn("before", F.col("__own") + F.col("__base")).drop("__own", "__base")
