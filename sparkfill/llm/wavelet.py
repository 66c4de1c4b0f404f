"""Operator 13, token ids as files: one wavelet matrix a shard.

A shard is a run of documents in ascending id order. Its token ids, laid end to end, are kept as
the bit planes of a wavelet matrix: plane 0 holds the highest bit of every id in text order; each
next plane holds the next bit, in the order that a stable sort by the bit before gives. Beside
each plane stand the number of its zeros and the ones before every 512th bit. From these alone

* ``access`` gives the id at a place,
* ``rank`` counts an id before a place (so, counting it in a document takes two ranks),
* ``select`` gives the place of its n-th occurrence,

each with a constant number of steps a plane. A file (Parquet, zstd) holds the shards of one
range of document ids, one row a shard, with a directory of its documents; nothing else is needed
to read it.

Texts are dealt once, by ranges of (id, hash of the text, running number), so that rows of one id
are split too, and are encoded where they land. A shard ends with the document that makes it
``shard_tokens`` long; memory is bounded by that and the longest document. Places of documents
over all shards come from prefix sums of the shards' lengths in two levels.

Defined results: a null or empty text holds the end id alone; a null id stays null and comes first;
repeated rows are documents of their own, next to each other, and rows of one id with different
texts follow in the order of a hash of the text; very long texts are encoded whole, and one that is
longer than a shard is a shard of its own; ties between equal rows don't matter, as they are equal;
an empty table gives a folder without shards and an empty result. Other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfill.llm.bpe import byte_of_char
from sparkfill.llm.text import distinct, of_worker, running_total, runs, slices, text_key, two_columns
from sparkfill.session import broadcast_checked, shared_path

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
#: Tokens after which a shard ends.
SHARD_TOKENS = 1 << 24
#: Bytes of text a file is meant for.
FILE_BYTES = 32 << 20
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 6_000_000
#: Bits between two stored ranks.
STEP = 512

SHARDS = ("part long, shard long, n_tokens long, doc_ids array<long>, starts array<long>, "
          "zeros array<long>, planes array<binary>, ranks array<binary>")
_SHARDS = pa.schema([
    ("part", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary()))])


# --------------------------------------------------------------------------- encoding

#: Fixed values of the word vocabulary: how a word is cut into pieces, and the mark of a piece's end.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "</w>"
_PIECE = regex.compile(f"({PIECES})")
#: Words that the quick way takes: printable and Latin, without the signs that special strings start with.
_PLAIN = regex.compile(r"(?:[!-;=-~¡-ɏ]|<(?!\|))+")
_WORD = regex.compile(r"\S+")
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to str.split, not to the tokenizer
_MARK, _BREAK = "\x01", "\n"


class WordEncoder:
    """``encode(texts)``: the ids of each text as the library gives them, as unsigned integers.

    The tokenizer drops white space and never merges over it, so a text's ids are those of its
    words. The distinct words of a batch are encoded in one call and laid out by their numbers.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.bits = max(1, (size - 1).bit_length())
        self.quick, self.of_rank = _quick_merges(path, self.dtype)

    def _slow(self, word: str) -> np.ndarray:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.dtype)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and where each begins."""
        quick = np.array([bool(self.quick) and (w.isascii() and w.isprintable() and "<" not in w or bool(_PLAIN.fullmatch(w))) for w in words], bool)
        marked = _PIECE.sub(r"\1" + _MARK, _BREAK.join([*(w for w, q in zip(words, quick, strict=True) if q), ""]).lower())
        ranks = self.quick.encode_to_numpy(marked) if quick.any() else np.empty(0, np.uint32)  # there are no special tokens
        ends = np.flatnonzero(ranks == ord(_BREAK))
        ids = self.of_rank[ranks[ranks != ord(_BREAK)]] if quick.any() else np.empty(0, self.dtype)
        sizes = np.zeros(len(words), np.int64)
        sizes[quick] = np.diff(np.concatenate([[-1], ends])) - 1
        rest = {i: self._slow(words[i]) for i in np.flatnonzero(~quick).tolist()}
        if not rest:
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        for i, own in rest.items():
            sizes[i] = len(own)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(starts[-1], self.dtype)
        is_quick = np.repeat(quick, sizes)
        out[is_quick] = ids
        out[~is_quick] = np.concatenate(list(rest.values()))
        return out, starts

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        odd = np.array([any(c in t for c in _CONTROL) for t in texts], bool)
        lists = [pc.utf8_split_whitespace(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.string())),
                 pa.array([_WORD.findall(t) for t, o in zip(texts, odd, strict=True) if o], pa.list_(pa.string()))]
        words, which, begins = distinct(lists)
        flat, ends = runs(*self._words(words), which)
        found = iter(np.split(flat, ends[begins[1:-1]])) if len(texts) else iter(())
        out: list = [None] * len(texts)
        for i in [*np.flatnonzero(~odd).tolist(), *np.flatnonzero(odd).tolist()]:
            out[i] = next(found)
        return out


def _quick_merges(path: str, dtype: np.dtype):
    """The same merges in a quicker library, in which a piece's end is a byte of its own.

    None if the file isn't of the kind that :data:`PIECES` describes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer") or {})
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or normal != ["NFC", "Replace", "Lowercase"] or '"ByteLevel"' not in pre:
        return None, None
    back, mark = byte_of_char(), _MARK.encode()
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: 256 + b for b in range(256)}
    ids = {}
    for token, i in model["vocab"].items():
        plain = token.removesuffix(END)
        if all(c in back for c in plain):
            ids[bytes(back[c] for c in plain) + (mark if plain != token else b"")] = i
    for k, merge in enumerate(model["merges"]):
        joined = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        plain = joined.removesuffix(END)
        ranks.setdefault(bytes(back[c] for c in plain) + (mark if plain != joined else b""), 512 + k)
    of_rank = np.zeros(max(ranks.values()) + 1, dtype)
    for token, r in ranks.items():
        of_rank[r] = ids.get(token, 0)
    return tiktoken.Encoding("words", pat_str=f"[^{_MARK}{_BREAK}]+{_MARK}|{_BREAK}", mergeable_ranks=ranks, special_tokens={}), of_rank


def word_encoder(path: str) -> WordEncoder:
    """One copy for each Python worker."""
    return of_worker(("words", path), lambda: WordEncoder(path))


# --------------------------------------------------------------------------- the structure

class WaveletMatrix:
    """Bit planes of a sequence of ids, with rank and select on each plane."""

    def __init__(self, n: int, zeros: Sequence[int], planes: Sequence[bytes], ranks: Sequence[bytes]):
        self.n, self.zeros = int(n), [int(z) for z in zeros]
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4").astype(np.int64) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for level in range(bits):
            ones = ((ids & ids.dtype.type(1 << (bits - 1 - level))) != 0).view(np.uint8)
            packed = np.packbits(ones, bitorder="little")
            count = np.bitwise_count(packed)
            padded = np.zeros(-(-len(packed) // (STEP // 8)) * (STEP // 8), np.uint8)
            padded[: len(count)] = count
            per_step = padded.reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64)
            before = np.cumsum(per_step) - per_step
            high = ones.view(bool)
            rest = ids[~high]
            zeros.append(len(rest))
            planes.append(packed.tobytes())
            ranks.append(before.astype("<u4").tobytes())
            ids = np.concatenate([rest, ids[high]])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane."""
        plane, ranks = self.planes[level], self.ranks[level]
        if not len(plane):
            return np.zeros(at.shape, np.int64)
        step = np.minimum(at // STEP, len(ranks) - 1)
        first = step * (STEP // 8)
        whole = (at >> 3) - first
        byte = first[:, None] + np.arange(STEP // 8)
        held = np.where(np.arange(STEP // 8) < whole[:, None], np.bitwise_count(plane[np.minimum(byte, len(plane) - 1)]), 0)
        last = plane[np.minimum(at >> 3, len(plane) - 1)] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return ranks[step] + held.sum(axis=1, dtype=np.int64) + np.bitwise_count(last)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        ids = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, at)
            ones = self._ones_before(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            ids = ids * 2 + bit
        return ids

    def rank(self, token: int, at) -> np.ndarray:
        """How often ``token`` occurs before each of the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if token < 0 or token >> len(self.zeros):
            return np.zeros(len(at), np.int64)
        first = np.zeros(1, np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones_before(level, first), self._ones_before(level, at)
            one = token >> (len(self.zeros) - 1 - level) & 1
            first, at = (zeros + a, zeros + b) if one else (first - a, at - b)
        return at - first

    def select(self, token: int, nth) -> np.ndarray:
        """The places of the ``nth`` occurrences (from 0); they must exist."""
        nth = np.atleast_1d(np.asarray(nth, np.int64))
        if len(nth) and (nth.min() < 0 or nth.max() >= self.rank(token, self.n)[0]):
            raise IndexError(f"token {token} does not occur that often")
        first = np.zeros(1, np.int64)
        for level, zeros in enumerate(self.zeros):
            a = self._ones_before(level, first)
            first = zeros + a if token >> (len(self.zeros) - 1 - level) & 1 else first - a
        at = first + nth
        for level in reversed(range(len(self.zeros))):
            if token >> (len(self.zeros) - 1 - level) & 1:
                at = self._nth_place(level, at - self.zeros[level], ones=True)
            else:
                at = self._nth_place(level, at, ones=False)
        return at

    def _nth_place(self, level: int, nth: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the bit that has ``nth`` like bits before it: a stored rank, then the bits of its step."""
        before = self.ranks[level] if ones else np.arange(len(self.ranks[level])) * STEP - self.ranks[level]
        step = np.searchsorted(before, nth, side="right") - 1
        byte = step[:, None] * (STEP // 8) + np.arange(STEP // 8)
        plane = self.planes[level]
        bits = np.unpackbits(plane[np.minimum(byte, len(plane) - 1)], axis=1, bitorder="little")
        like = np.cumsum(bits if ones else 1 - bits, axis=1, dtype=np.int64)
        return step * STEP + np.argmax(like > (nth - before[step])[:, None], axis=1)

    def positions(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending."""
        return self.select(token, np.arange(self.rank(token, self.n)[0]))

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All ids in order: from the last plane up, each undoes one stable sort."""
        ids = np.zeros(self.n, dtype)
        for level in reversed(range(len(self.zeros))):
            high = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            ids[self.zeros[level] :] |= ids.dtype.type(1 << (len(self.zeros) - 1 - level))
            above = np.empty_like(ids)
            above[high] = ids[self.zeros[level] :]
            above[np.logical_not(high, out=high)] = ids[: self.zeros[level]]
            ids = above
        return ids


# --------------------------------------------------------------------------- files

def _shard_rows(tokenizer: str, end_id: int, shard_tokens: int):
    def one(part: int, shard: int, doc_ids: list, ids: list[np.ndarray], bits: int) -> pa.RecordBatch:
        lengths = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids)
        ids.clear()  # not needed beside their copy
        m = WaveletMatrix.build(flat, bits)
        row = [part, shard, m.n, doc_ids, (np.cumsum(lengths) - lengths).tolist(), m.zeros,
               [p.tobytes() for p in m.planes], [r.astype("<u4").tobytes() for r in m.ranks]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARDS, strict=True)], schema=_SHARDS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        if end_id >> enc.bits:
            raise ValueError(f"end id {end_id} does not fit {enc.bits} bits")
        end = np.array([end_id], enc.dtype)
        part, shard, doc_ids, ids, held = None, 0, [], [], 0
        for batch in slices(batches, most=ENCODE_BYTES):
            part = batch.column("part")[0].as_py()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([own, end]))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield one(part, shard, doc_ids, ids, enc.bits)
                    shard, doc_ids, ids, held = shard + 1, [], [], 0
        if ids:
            yield one(part, shard, doc_ids, ids, enc.bits)

    return make


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT,
                 end_id: int = 1, shard_tokens: int = SHARD_TOKENS, file_bytes: int = FILE_BYTES) -> str:
    """Encode all documents in ascending id order into shards under ``path`` and return it.

    Without a path, a fresh one in the shared folder is taken.
    """
    path = path or shared_path(docs.sparkSession, "tokens")
    own = two_columns(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.withColumn("key", text_key(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("row")]
    dealt = own.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    dealt.mapInArrow(_shard_rows(tokenizer, end_id, shard_tokens), SHARDS).write.option("compression", "zstd").parquet(path)
    return path


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, shard, before``: the ids of all shards before each one."""
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "n_tokens")
    return running_total(shards, "part", "shard", "n_tokens").select("part", "shard", "before")


def _each(rows: Iterator[pa.RecordBatch]):
    """The rows, without their planes, and the matrices, whose planes stay where Arrow has them."""
    for batch in rows:
        plain = batch.select([n for n in batch.schema.names if n not in ("planes", "ranks")])
        for i in range(batch.num_rows):
            r = plain.slice(i, 1).to_pylist()[0]
            planes, ranks = ([x.as_buffer() for x in batch.column(n)[i].values] for n in ("planes", "ranks"))
            yield r, WaveletMatrix(r["n_tokens"], r["zeros"], planes, ranks)


def _with_starts(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    before = shard_starts(spark, path).withColumnsRenamed({"part": "s_part", "shard": "s_shard"})
    return found.join(broadcast_checked(before), (F.col("part") == F.col("s_part")) & (F.col("shard") == F.col("s_shard")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    ddl = "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long"

    def read(rows):
        for r, m in _each(rows):
            ids = m.decode("<u2" if len(m.zeros) <= 16 else "<u4")
            stops = [*r["starts"][1:], m.n]
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(r["starts"], stops, strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["part"]] * n, pa.int64()), pa.array([r["shard"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()),
                pa.array(r["starts"], pa.int64()), pa.array(np.subtract(stops, r["starts"]), pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARDS).parquet(path)
    found = _with_starts(spark, path, shards.mapInArrow(read, ddl))
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, start, n``: how often ``token`` occurs in each document that has it, by two ranks."""
    def read(rows):
        for r, m in _each(rows):
            at = m.rank(token, [*r["starts"], m.n])
            n = np.diff(at)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["part"]] * len(has), pa.int64()), pa.array([r["shard"]] * len(has), pa.int64()),
                pa.array([r["doc_ids"][i] for i in has], pa.int64()), pa.array([r["starts"][i] for i in has], pa.int64()),
                pa.array(n[has], pa.int64())], names=["part", "shard", "doc_id", "at", "n"])

    shards = spark.read.schema(SHARDS).parquet(path)
    found = _with_starts(spark, path, shards.mapInArrow(read, "part long, shard long, doc_id long, at long, n long"))
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, start, place``: every occurrence of ``token`` (its place in the document), by selects."""
    def read(rows):
        for r, m in _each(rows):
            starts = np.array(r["starts"], np.int64)
            n = int(m.rank(token, m.n)[0])
            for a in range(0, n, 1 << 14):
                at = m.select(token, np.arange(a, min(n, a + (1 << 14))))
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"]] * len(at), pa.int64()), pa.array([r["shard"]] * len(at), pa.int64()),
                    pa.array([r["doc_ids"][i] for i in doc], pa.int64()), pa.array(starts[doc]), pa.array(at - starts[doc])],
                    names=["part", "shard", "doc_id", "at", "place"])

    shards = spark.read.schema(SHARDS).parquet(path)
    found = _with_starts(spark, path, shards.mapInArrow(read, "part long, shard long, doc_id long, at long, place long"))
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "place")
