"""Operator 2, benchmark decontamination: suffix arrays of the corpus, searched for every test window.

The corpus is cut into shards as it is read: some documents each, their words as numbers,
with a break after each document. A shard's suffix array sorts its positions by the words
that follow, as far as a window goes (prefix doubling). Each distinct window of the benchmark
items (an item shorter than a window is one) is then binary-searched in it, which gives
the first and last place of its occurrences. Longer matches are chained from windows that
occur one word after another; a match shorter than a window (or than its whole item, if
that is shorter) is not found, and ``longest`` is 0 then. Positions from which no whole
window of benchmark words follows are left out of the array: no window can start there, and
most of a corpus is such.

Shards are searched where they are read; nothing is shuffled. The benchmark goes to the
tasks in blocks of bounded size, one pass for each, so it may grow as it likes.

Defined results: a null or empty text, or one without words, has none and is not
contaminated; items without words have no window, items without an id are left out; equal windows of several items count
for each; repeated rows give repeated results; an empty table on either side gives zero
hits. Other columns of the inputs are neither read nor returned by ``find_overlaps``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.text import folded_words, slices

#: Bytes of benchmark text that go to every task at once.
BLOCK_BYTES = 32_000_000
#: Bytes of corpus text in a shard.
SHARD_BYTES = 8_000_000

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ("items", pa.list_(pa.int64())), ("longest", pa.int64()),
])

def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` sorted by the ``depth`` words that follow each, and their ranks.

    Prefix doubling: positions are ranked by 1, 2, 4, ... words. ``words`` must be followed
    by ``depth`` zeros, and zeros break documents apart.
    """
    rank = words.astype(np.int64)
    for step in (1 << k for k in range(max(0, depth - 1).bit_length())):
        here = np.flatnonzero(rank)  # what starts with a break is of no interest
        pair = rank[here] * (rank.max() + 1) + np.concatenate([rank, np.zeros(step, np.int64)])[here + step]
        _, own = np.unique(pair, return_inverse=True)
        rank[here] = own + 1
    order = starts[np.argsort(rank[starts], kind="stable")]
    return order, rank


class Benchmark:
    """A block of items as word numbers, with their windows."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.number: dict[bytes, int] = {}
        self.window = window
        self.items: dict[int, list[np.ndarray]] = {}
        self.of_window: dict[bytes, int] = {}  # the number of each distinct window
        self.holders: list[set[int]] = []  # the items that hold it
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in folded_words(text)], np.int32)
            n = min(window, len(ids))
            if n:
                self.items.setdefault(item, []).append(ids)
            for i in range(len(ids) - n + 1 if n else 0):
                k = self.of_window.setdefault(ids[i : i + n].tobytes(), len(self.holders))
                if k == len(self.holders):
                    self.holders.append(set())
                self.holders[k].add(item)
        self.windows = [np.frombuffer(w, np.int32) for w in self.of_window]
        self.shortest = min(map(len, self.windows), default=0)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and places of all occurrences in a shard."""
        breaks = np.concatenate([[-1], np.flatnonzero(words == 0), [len(words)]])
        runs = np.diff(breaks) - 1  # of benchmark words, from one break to the next
        at = np.flatnonzero(runs >= self.shortest) if self.shortest else np.empty(0, np.int64)
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.zeros(len(words) + 2 * self.window, words.dtype)  # shorter runs hold no window
        kept = np.repeat(breaks[at] + 1 - np.cumsum(runs[at]) + runs[at], runs[at]) + np.arange(runs[at].sum())
        padded[kept] = words[kept]
        starts = kept[padded[kept + self.shortest - 1] > 0]
        starts = starts[np.repeat(breaks[at + 1], runs[at])[np.searchsorted(kept, starts)] - starts >= self.shortest]
        order, _ = suffix_array(padded, starts, self.window)
        # binary search, one word after another, for all windows at once: the range of
        # suffixes that share the first k words, narrowed by word k + 1
        lo, hi = np.zeros(len(self.windows), np.int64), np.full(len(self.windows), len(order))
        for k in range(self.window):
            alive = np.array([len(w) > k for w in self.windows]) & (lo < hi)
            if not alive.any():
                break
            wanted = np.array([w[k] if len(w) > k else 0 for w in self.windows], np.int32)
            column = padded[order + k]
            lo[alive], hi[alive] = _narrow(column, lo[alive], hi[alive], wanted[alive])
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        return which, order[np.arange(len(which)) - np.repeat(ends - counts, counts) + np.repeat(lo, counts)]


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of ``wanted`` in each sorted range ``column[lo:hi]``, by bisection of all ranges together."""
    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            value = column[np.minimum(mid, len(column) - 1)]
            up = open_ & ((value <= wanted) if right else (value < wanted))
            a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
        return a

    return bound(False), bound(True)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _longest(benchmark: Benchmark, held: set[int], which: list[int], places: list[int]) -> int:
    """Words of the longest run of a document that an item also has, among its occurring windows."""
    best, at = 0, {}
    for w, p in zip(which, places, strict=True):
        at.setdefault(w, []).append(p)
    for words in (words for item in held for words in benchmark.items[item]):
        n = min(benchmark.window, len(words))
        run: dict[int, int] = {}  # by the place after it: words of the match that ends here
        for i in range(len(words) - n + 1):
            found = at.get(benchmark.of_window[words[i : i + n].tobytes()], ())
            run = {p + 1: run.get(p, n - 1) + 1 for p in found}
            best = max([best, *run.values()])
    return best


def _scan(broadcast, shard_bytes: int):
    def scan(batches):
        benchmark: Benchmark = broadcast.value
        number = benchmark.number.get
        for batch in slices(batches, most=shard_bytes):
            rows = {name: batch.column(name).to_pylist() for name in _OUT.names if name != "text"}
            texts = batch.column("text").to_pylist()
            parts, at, counts = [], [0], []
            for text in texts:
                words = folded_words(text)
                counts.append(len(words))
                parts += [np.fromiter((number(w, 0) for w in words), np.int32, len(words)), np.zeros(1, np.int32)]
                at.append(at[-1] + len(words) + 1)
            words = np.concatenate(parts) if parts else np.empty(0, np.int32)
            which, places = benchmark.search(words)
            of_doc = np.searchsorted(at, places, side="right") - 1
            order = np.argsort(of_doc, kind="stable")
            cuts = np.searchsorted(of_doc[order], np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                rows["n_words"][d] = counts[d]
                if cuts[d] == cuts[d + 1]:
                    continue
                own = order[cuts[d] : cuts[d + 1]]
                windows, starts = which[own].tolist(), (places[own] - at[d]).tolist()
                spans = [(p, p + len(benchmark.windows[w])) for w, p in zip(windows, starts, strict=True)]
                rows["spans"][d] = _merged(spans + [(s["start"], s["stop"]) for s in rows["spans"][d]])
                held = set().union(*(benchmark.holders[w] for w in set(windows)))
                rows["items"][d] = sorted(held | set(rows["items"][d]))
                rows["longest"][d] = max(rows["longest"][d], _longest(benchmark, held, windows, starts))
            arrays = [pa.array(rows[f.name], f.type) if f.name in rows else batch.column(f.name) for f in _OUT]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("row")], names=[*_OUT.names, "row"])

    return scan


def _overlaps(docs: DataFrame, benchmark: DataFrame, row, window: int, id_col: str, text_col: str,
              item_col: str, item_text_col: str, block_bytes: int, shard_bytes: int) -> DataFrame:
    """The results for each document, beside the column ``row``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.expr("0L n_words"),
        F.expr("cast(array() as array<struct<start: int, stop: int>>) spans"),
        F.expr("cast(array() as array<long>) items"), F.expr("0L longest"), row.alias("row"),
    )
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in block], window))
        out = out.mapInArrow(_scan(sent, shard_bytes), out.schema)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Words of each document that lie in a benchmark window.

    Returns ``doc_id, text, n_words, spans`` (word ranges, merged), ``items`` (ids, sorted)
    and ``longest`` (words of the longest verbatim match; 0 without a whole window).
    """
    return _overlaps(docs, benchmark, F.lit(0), window, id_col, text_col, item_col, item_text_col, block_bytes, shard_bytes).drop("row")


def digest(overlaps: DataFrame) -> DataFrame:
    """The numbers of :func:`find_overlaps` a document, without texts."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return overlaps.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; whole rows stay as they are."""
    found = _overlaps(docs, benchmark, F.struct("*"), window, id_col, text_col, item_col, item_text_col, block_bytes, shard_bytes)
    return found.where(F.size("spans") == 0).select("row.*")
