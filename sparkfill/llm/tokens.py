"""Operator 1, token counts: prefix dynamic programming over byte-level BPE.

For every prefix of a piece, the token that ends it is the one token that can follow the
last token of what is before it: ``last[i] = t`` where ``t`` ends at ``i`` and the pair
``(last[i - len(t)], t)`` is left alone by the merges. Then ``count[i] = count[i - len(t)]
+ 1`` is the exact number of tokens of that prefix encoded alone. So one pass gives the
count at every prefix, and truncation and budget questions need no encoding again.

Defined results: a null or empty text has 0 tokens and an empty prefix table; a null id
stays null; repeated rows give repeated results; an empty table gives an empty table.
Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.bpe import _PIECE, _SPACE, Vocabulary, batch_chunks
from sparkfill.llm.text import of_worker, runs, slices, two_columns

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
_BREAK = "\u0100"  # no byte


class PrefixCounts:
    """``deltas(texts)``: by how much the token count changes with each character of each text (16 bit).

    The distinct chunks of a batch go through one automaton of all tokens, which tells at each place
    the tokens that end there, the longest first; the first that stays apart from the token
    before it is the last token of the prefix.
    """

    def __init__(self, path: str):
        self.vocab = vocab = Vocabulary(path)
        self._automaton = ahocorasick.Automaton()
        self._size = [0] * (max(vocab.ids.values()) + 1)
        for token, i in vocab.ids.items():
            self._automaton.add_word(token.decode("latin-1"), i)
            self._size[i] = len(token)
        self._automaton.make_automaton()
        self._apart: dict[int, bool] = {}
        self._bytes = {i: t for t, i in vocab.ids.items()}
        self._rank = {i: r for r, i in enumerate(vocab.of_rank.tolist())}

    def _stay_apart(self, before: int, token: int) -> bool:
        """Whether the merges leave a pair of tokens as it is."""
        if len(self._apart) > 300_000:
            self._apart.clear()
        merged = self.vocab.quick._encode_single_piece(self._bytes[before] + self._bytes[token])
        known = self._apart[before << 32 | token] = merged == [self._rank[before], self._rank[token]]
        return known

    def _counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Change of the token count by each byte of the pieces, one after another, and where each piece begins."""
        data = [p.encode() for p in pieces]
        # a break is no part of any token, so nothing is found across it
        joined = _BREAK.join([*(d.decode("latin-1") for d in data), ""])
        count, last = [0] * (len(joined) + 1), [-1] * (len(joined) + 1)
        size, apart = self._size, self._apart
        for end, token in self._automaton.iter(joined):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            before = last[start]
            if before >= 0:
                key = before << 32 | token
                if not (apart[key] if key in apart else self._stay_apart(before, token)):
                    continue
            count[end], last[end] = count[start] + 1, token
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        deltas = np.diff(np.array(count, np.int32))
        breaks = np.cumsum(sizes + 1) - 1
        return np.delete(deltas, breaks), np.concatenate([[0], np.cumsum(sizes)])

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Change of the count by each character of the chunks, one after another, and where each chunk begins."""
        pieces = list(map(_PIECE.findall, chunks))
        # a prefix that ends in the white space of a chunk has it as one piece
        blanks = [_SPACE.match(c).group() for c in chunks]
        long = [i for i, b in enumerate(blanks) if len(b) > 1]
        by_byte, _ = self._counts([p for own in pieces for p in own] + [blanks[i] for i in long])
        text = "".join(chunks) + "".join(blanks[i] for i in long)
        data = np.frombuffer(text.encode(), np.uint8)
        by_char = np.add.reduceat(by_byte, np.flatnonzero((data & 0xC0) != 0x80)) if len(data) else by_byte
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = starts[-1]
        for i in long:
            n, a = len(blanks[i]), starts[i]
            own = by_char[at : at + n]
            if n < sizes[i]:  # the character after it brings back what the pieces have
                by_char[a + n] += by_char[a : a + n].sum() - own.sum()
            by_char[a : a + n] = own
            at += n
        return by_char[: starts[-1]].astype(np.int16), starts

    def deltas(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.vocab.segments(t) for t in texts]
        # until its last character, a special string is ordinary text after what precedes it
        ordinary = [own[i] + (own[i + 1][:-1] if i + 1 < len(own) else "") for own in parts for i in range(0, len(own), 2)]
        chunks, which, begins = batch_chunks(ordinary)
        flat, ends = runs(*self._of_chunks(chunks), which)
        found = iter(np.split(flat, ends[begins[1:-1]])) if parts else iter(())
        out = []
        for own in parts:
            made = []
            for i in range(0, len(own), 2):
                made.append(next(found))
                if i + 1 < len(own):
                    before = made[-1][: len(own[i])].sum()
                    made.append(np.array([before + 1 - made[-1].sum()], np.int16))
            out.append(np.concatenate(made) if len(made) > 1 else made[0])
        return out


def _counter(path: str) -> PrefixCounts:
    """One copy for each Python worker."""
    return of_worker(("prefixes", path), lambda: PrefixCounts(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT,
                 budgets: tuple[int, ...] = (), with_prefixes: bool = False) -> DataFrame:
    """Exact token counts of whole texts from their prefix tables.

    Returns ``doc_id, n_bytes, n_tokens``; for each budget ``cut_<budget>``, the number of
    characters of the longest prefix within it; with ``with_prefixes`` also
    ``prefix_counts``, the table itself (little-endian 32-bit counts, one a character),
    for :func:`prefix_tokens`.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64())]
    fields += [pa.field(f"cut_{b}", pa.int64()) for b in budgets]
    fields += [pa.field("prefix_counts", pa.binary())] * with_prefixes
    schema = pa.schema(fields)
    ddl = ", ".join(f"{f.name} {'binary' if f.name == 'prefix_counts' else 'long'}" for f in fields)

    def count(batches):
        counter = _counter(tokenizer)
        for batch in slices(batches):
            cols, texts = [[] for _ in fields], [t or "" for t in batch.column("text").to_pylist()]
            for text, deltas in zip(texts, counter.deltas(texts), strict=True):
                table = np.cumsum(deltas, dtype=np.int32)
                row = [len(text.encode()), int(table[-1]) if len(table) else 0]
                row += [len(table) - int(np.argmax((table <= b)[::-1])) if len(table) and table.min() <= b else 0 for b in budgets]
                row += [table.astype("<i4").tobytes()] * with_prefixes
                for col, value in zip(cols[1:], row, strict=True):
                    col.append(value)
            arrays = [batch.column("doc_id").cast(pa.int64())]
            arrays += [pa.array(c, f.type) for c, f in zip(cols[1:], fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return two_columns(docs, id_col, text_col).mapInArrow(count, ddl)


def prefix_tokens(prefix_counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, read off the stored table."""
    at = F.least(n_chars, F.octet_length(prefix_counts) / 4).cast("int")
    byte = [F.conv(F.hex(F.substring(prefix_counts, (at - 1) * 4 + k, 1)), 16, 10).cast("long") for k in (1, 2, 3, 4)]
    return F.when(at <= 0, F.lit(0)).otherwise(byte[0] + byte[1] * 256 + byte[2] * 65536 + byte[3] * 16777216)
