"""Operator 4, substring dedup: recurring passages, found again by sharded Aho-Corasick automata.

A window is ``window`` words in a row; its words go if the same words start anywhere else.

1. *Anchors.* Of every ``window - k + 1`` consecutive k-gram hashes the least is chosen, so a
   window holds a chosen k-gram at the same place wherever it occurs. Only anchors that
   occur twice or more can lie in a recurring window; the others, nearly all, go.
2. *Shards.* Around each recurring anchor, the words that windows through it can reach are cut
   out of the document. These segments meet by anchor, so a shard holds all that can
   match its passages, of all documents.
3. *Confirm and compile.* In a shard, windows are counted by their exact words. Those that
   occur at two places recur. A segment's recurring windows next to each other are one
   phrase, and the phrases of many anchors are compiled into an Aho-Corasick automaton.
4. *Stream.* The shard's segments run through the automaton, which locates every occurrence of
   every phrase; the places go back to their documents, and covered words are removed.

An anchor with more segments than ``HOT`` would be one large task. Its windows are counted by
a 128-bit hash instead, with partial aggregation, so they spread over the cluster; the
result is the same.

Defined results: a null text has no words; a text of fewer words than ``window`` has no window
and stays; repeated rows of one id and text are occurrences of each other, and get the same
result each; rows of one id and different texts are documents of their own; a null id stays
null; an empty table gives an empty table. Other columns are neither read nor returned.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from itertools import count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.text import hashed_words, hex_sha256, ngram_hashes, slices, space_words, text_key
from sparkfill.session import broadcast_checked, shared_path

#: Words of an anchor.
K = 8
#: Segments of one anchor that are compared in one task: some 8 MB of words, 200 MB with all their windows.
HOT = 20_000
#: Words of the phrases of one automaton.
AUTOMATON_NODES = 200_000

_ANCHORS = "doc_id long, text_key long, n_words long, full_sha256 string, at array<int>, anchor array<long>"
_SEGMENT = "doc_id long, text_key long, row long, anchor long, first int, words binary"
_SPANS = "doc_id long, text_key long, start int, stop int"


def _sliding(values: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or largest) of each ``n`` values in a row, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < n:
        step = min(have, n - have)
        values = f(values[:-step], values[step:])
        have += step
    return values


def _chosen(grams: np.ndarray, n: int) -> np.ndarray:
    """Places of the values that are the least of some ``n`` in a row; ties are all chosen."""
    if len(grams) < n:
        return np.empty(0, np.int64)
    least = _sliding(grams, n, True)
    around = np.concatenate([np.zeros(n - 1, np.uint64), least, np.zeros(n - 1, np.uint64)])
    return np.flatnonzero(_sliding(around, n, False) == grams)


def anchors(hashes: np.ndarray, window: int, k: int = K) -> np.ndarray:
    """Places of the k-grams that are the least in some window; ties are all chosen."""
    return _chosen(ngram_hashes(hashes, k), window - k + 1)


def _find_anchors(window: int, k: int):
    names = ["doc_id", "text_key", "n_words", "full_sha256", "at", "anchor"]

    def find(batches):
        for batch in slices(batches):
            count, full, places, values = [], [], [], []
            texts = batch.column("text").to_pylist()
            flat, begins = hashed_words(texts)
            grams = ngram_hashes(flat, k)  # of all texts at once; those that reach into the next one are left out
            for text, a, b in zip(texts, begins.tolist(), begins[1:].tolist(), strict=False):
                own = grams[a : max(a, b - k + 1)]
                at = _chosen(own, window - k + 1)
                count.append(b - a)
                full.append(hex_sha256(b" ".join(space_words(text))))
                places.append(at.astype(np.int32))
                values.append(own[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(count, pa.int64()), pa.array(full),
                pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=names)

    return find


def _cut_segments(window: int, k: int):
    """Segments of the recurring anchors of each row: all words that a window with the anchor can hold."""
    reach = window - k
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("first", pa.int32()), ("words", pa.binary())])

    def cut(batches):
        for batch in slices(batches, most=500_000):
            recurring = batch.column("recurring")
            each = pc.list_value_length(recurring).to_numpy(zero_copy_only=False)
            at, anchor = (recurring.flatten().field(f) for f in ("at", "anchor"))
            places, out, firsts, done = at.to_numpy(), [], [], 0
            for text, n in zip(batch.column("text").to_pylist(), each.tolist(), strict=True):
                words = space_words(text)
                joined = b" ".join(words)
                begins = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # of each word, and of one after the last
                mine = places[done : done + n]
                first = np.maximum(mine - reach, 0)
                stop = begins[np.minimum(mine + window, len(words))] - 1
                out += [joined[a:b] for a, b in zip(begins[first].tolist(), stop.tolist(), strict=True)]
                firsts.append(first)
                done += n
            row = pa.array(np.repeat(np.arange(len(each)), each))
            cols = [*(batch.column(c).take(row) for c in ("doc_id", "text_key", "row")), anchor,
                    np.concatenate(firsts) if firsts else [], out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return cut


def _phrases(segments: list[tuple], window: int) -> set[bytes]:
    """What recurs in the segments of one anchor: their longest runs of recurring windows.

    ``segments``: (document key, first word's place, words). The same place of a document may lie in
    several segments; it counts once. Segments alike at two places recur whole; in the others,
    windows are told apart by their words, each cut out of the joined words as it is.
    """
    number: defaultdict[tuple, int] = defaultdict(count().__next__)
    places: dict[bytes, set[int]] = defaultdict(set)
    for doc, first, words in segments:
        places[words].add((number[doc] << 32) + first)
    out = {words for words, at in places.items() if len(at) > 1 and words.count(b" ") >= window - 1}
    if len(out) == len(places):
        return out
    one_place: dict[bytes, int] = {}
    recurs: set[bytes] = set()
    cuts = {}
    for words, at in places.items():
        blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
        begins = [0, *(b + 1 for b in blanks)]
        cuts[words] = windows = [words[a:b] for a, b in zip(begins, [*blanks, len(words)][window - 1 :], strict=False)]
        if words in out:
            recurs.update(windows)
            continue
        for w, place in zip(windows, count(min(at)), strict=False):
            if one_place.setdefault(w, place) != place:
                recurs.add(w)
    for words, windows in cuts.items():
        if words in out or recurs.isdisjoint(windows):
            continue
        if recurs.issuperset(windows):
            out.add(words)
            continue
        begins = None
        for i, w in enumerate([*windows, None]):
            if w in recurs:
                if begins is None:
                    begins = i
            elif begins is not None:
                out.add(b" ".join(words.split(b" ")[begins : i - 1 + window]))
                begins = None
    return out


class _Shard:
    """Anchors gathered until their phrases fill an automaton; then their segments are streamed through.

    The automaton's letters are words, numbered as they come, so a phrase has a node a word.
    """

    def __init__(self, window: int):
        self.window = window
        self.empty()

    def empty(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.number = defaultdict(count().__next__)
        self.letters: dict[bytes, tuple[int, ...]] = {}
        self.segments: list[tuple] = []
        self.nodes = 0

    def _letters(self, words: bytes) -> tuple[int, ...]:
        known = self.letters.get(words)  # a phrase is often a whole segment
        if known is None:
            each = words.split(b" ")
            known = self.letters[words] = itemgetter(*each)(self.number) if len(each) > 1 else (self.number[words],)
        return known

    def add(self, segments: list[tuple]) -> None:
        if len(segments) < 2:
            return
        found = _phrases(segments, self.window)
        for phrase in found:
            letters = self._letters(phrase)
            self.automaton.add_word(letters, len(letters))
            self.nodes += len(letters)
        if found:
            self.segments.extend(segments)

    def _covered(self, words: bytes) -> list[list[int]]:
        """Word ranges that phrases cover, merged."""
        letters = self._letters(words)
        if self.automaton.exists(letters):  # a phrase itself, so covered whole
            return [[0, len(letters)]]
        covered: list[list[int]] = []
        last = -1
        for end, n in self.automaton.iter(letters):
            if end == last:
                continue  # of the phrases that end at a word, the longest comes first
            last = end
            a, b = end + 1 - n, end + 1
            while covered and a <= covered[-1][0]:
                covered.pop()
            if covered and a <= covered[-1][1]:
                covered[-1][1] = b
            else:
                covered.append([a, b])
        return covered

    def spans(self):
        """``(document, start, stop)`` of every occurrence of every phrase."""
        if len(self.automaton):
            self.automaton.make_automaton()
            covered: dict[bytes, list[list[int]]] = {}
            for doc, first, words in self.segments:
                ranges = covered.get(words)
                if ranges is None:
                    ranges = covered[words] = self._covered(words)
                for a, b in ranges:
                    yield doc, first + a, first + b
        self.empty()


def _locate(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def table(spans):
        docs, starts, stops = zip(*spans, strict=True) if spans else ((), (), ())
        cols = [[d[0] for d in docs], [d[1] for d in docs], starts, stops]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def stream(batches):
        shard, held, key, out = _Shard(window), [], None, []
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "first", "words", "row"))
            for anchor, doc_id, text_key_, first, words, row in zip(*cols, strict=True):
                if anchor != key:
                    shard.add(held)
                    held, key = [], anchor
                    if shard.nodes > AUTOMATON_NODES or len(shard.segments) > HOT:
                        out.extend(shard.spans())
                held.append(((doc_id, text_key_, row), first, words))
            if len(out) > 20_000:
                yield table(out)
                out = []
        shard.add(held)
        out.extend(shard.spans())
        yield table(out)

    def locate(batches):
        gc.disable()  # nothing here makes cycles, and the many small tuples need not be looked through again and again
        try:
            yield from stream(batches)
        finally:
            gc.enable()

    return locate


def _window_hashes(window: int):
    """Two 64-bit hashes of each window of the segments of hot anchors."""
    def hashes(batches):
        for batch in slices(batches, "words"):
            out = defaultdict(list)
            for i, joined in enumerate(batch.column("words").to_pylist()):
                first, words = batch.column("first")[i].as_py(), joined.split(b" ")
                for j in range(len(words) - window + 1):
                    value = xxhash.xxh3_128_digest(b" ".join(words[j : j + window]))
                    out["i"].append(i)
                    out["start"].append(first + j)
                    out["hash"].append(value)
            ids = pa.array(out["i"], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(ids), batch.column("text_key").take(ids), batch.column("row").take(ids),
                pa.array(out["start"], pa.int32()), pa.array(out["hash"], pa.binary())], names=["doc_id", "text_key", "row", "start", "hash"])

    return hashes


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _remover():
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def remove(batches):
        for batch in slices(batches):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = space_words(text)
                gone = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["stop"]] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
                rows.append((len(words), len(words) - int(stays.sum()), kept.decode()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=names)

    return remove


def remove_repeats(docs: DataFrame, window: int = 35, k: int = K, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables that share out the rows of ``docs``.

    The first has ``doc_id, n_words, n_removed, kept`` of documents that lose words or might
    have, ``kept`` being the words that stay, joined by a space. The second has ``doc_id,
    n_words, full_sha256`` of those proven to lose none, whose words are as they were.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("text_key", text_key(F.col("text")))
    found = _written(own.mapInArrow(_find_anchors(window, k), _ANCHORS), "anchors")

    each = found.select("doc_id", "text_key", F.explode(F.arrays_zip("at", "anchor")).alias("a")).select("doc_id", "text_key", "a.at", "a.anchor")
    often = found.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("anchor").alias("n")).where("n > 1")
    often = _written(often, "often")
    many = broadcast_checked(often.where(F.col("n") > hot))  # a hot anchor's rows must not meet in one task
    rest = each.join(many.select("anchor"), "anchor", "left_anti").join(often.where(F.col("n") <= hot), "anchor")
    recurring = each.join(many, "anchor").union(rest).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "anchor", "n")).alias("recurring"))  # of one document
    r = recurring.withColumnsRenamed({"doc_id": "r_id", "text_key": "r_key"})
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key"))
    suspects = _written(own.join(r, same).drop("r_id", "r_key"), "suspects")

    numbered = suspects.withColumn("row", F.monotonically_increasing_id())  # repeated rows are apart

    def segments(of) -> DataFrame:
        some = numbered.withColumn("recurring", F.filter("recurring", of)).where(F.size("recurring") > 0)
        return some.mapInArrow(_cut_segments(window, k), _SEGMENT)

    cold = segments(lambda r: r["n"] <= hot).repartition("anchor").sortWithinPartitions("anchor")
    spans = cold.mapInArrow(_locate(window), _SPANS)
    warm = segments(lambda r: r["n"] > hot).mapInArrow(_window_hashes(window), "doc_id long, text_key long, row long, start int, hash binary").distinct()
    twice = warm.groupBy("hash").agg(F.count("hash").alias("c")).where("c > 1").select("hash")
    hot_spans = warm.join(twice, "hash").select("doc_id", "text_key", "start", (F.col("start") + window).cast("int").alias("stop"))

    of_doc = spans.union(hot_spans).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one document
    s = of_doc.withColumnsRenamed({"doc_id": "s_id", "text_key": "s_key"})
    back = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key"))
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    changed = suspects.join(s, back, "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    changed = changed.mapInArrow(_remover(), "doc_id long, n_words long, n_removed long, kept string")
    keys = suspects.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).distinct()
    return changed, found.join(keys, same, "left_anti").select("doc_id", "n_words", "full_sha256")


def digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    changed, same = remove_repeats(docs, **options)
    return changed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).union(
        same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("full_sha256").alias("kept_sha256")))
