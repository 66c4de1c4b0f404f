"""Byte-level BPE of a tokenizers file, cut into chunks that encode on their own.

The pre-tokenizer splits a text at every change from a word to white space, so a run of
white space and the piece after it never merge with anything else. Such chunks recur, so each
distinct one of a batch of texts is encoded once. The strings of special tokens inside a
text count as the library's default has it: one token each, with the text around them
encoded apart.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from sparkfill.llm.text import distinct, of_worker, runs

#: Fixed values of byte-level BPE: the split pattern, and the bytes that stand for themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_PIECE = regex.compile(SPLIT)
#: A byte that parts chunks which are encoded in one call; the pattern leaves it alone.
_MARK = "\x01"
_MARKED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?![^\s\x01])|\s+|\x01"""
#: White space and the piece after it; a contraction does not take a plain space before it.
_CHUNK = regex.compile(
    r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
)
_SPACE = regex.compile(r"\s*")


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tokens, ranks and special strings of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE without a normalizer")
        back = byte_of_char()
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = added
        self.ids = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(bytes(map(back.get, a)), bytes(map(back.get, b))): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.library = Tokenizer.from_file(path)
        # A BPE merge yields the token of its two parts; its rank orders the merges.
        ranks = {bytes([b]): b - 256 for b in range(256)} | {a + b: i for (a, b), i in self.rank.items()}
        self.quick = tiktoken.Encoding("ranks", pat_str=_MARKED, mergeable_ranks={t: i + 256 for t, i in ranks.items()}, special_tokens={})
        self.of_rank = np.zeros(len(ranks), np.uint32)
        for t, i in ranks.items():
            self.of_rank[i + 256] = self.ids[t]

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn; the odd places are special."""
        s = self.split_special
        return s.split(text) if s and any(t in text for t in self.special) else [text]


#: A text whose chunks are its words, parted by single blanks and line ends, has none of these.
_ODD = r"[\t\x0b-\x0d\x01-\x03\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
_HEAD, _WHOLE = "\x02", "\x03"


def batch_chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of ordinary texts, the number of each chunk's own, and where each text's begin."""
    odd = np.asarray(pc.match_substring_regex(pa.array(texts, pa.string()), _ODD)) if texts else np.empty(0, bool)
    marked = [_HEAD + t.replace("\n", " \n") for t, o in zip(texts, odd, strict=True) if not o]
    whole = [[_WHOLE + c for c in _CHUNK.findall(t)] for t, o in zip(texts, odd, strict=True) if o]
    words, which, begins = distinct([pc.split_pattern(pa.array(marked, pa.string()), " "), pa.array(whole, pa.list_(pa.string()))])
    chunks = [w[1:] if w[0] in "\x02\x03" else w if w[0] == "\n" else " " + w for w in words]
    if whole and marked:  # back to the order of the texts
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable")
        sizes = np.diff(begins)
        which, ends = runs(which, begins, order)
        begins = np.concatenate([[0], np.cumsum(sizes[order])])
    return chunks, which, begins


def _plain(chunk: str) -> bool:
    """Whether the quicker library classes all characters of a chunk alike."""
    word = chunk.lstrip("\n ")
    return word.isprintable() and (word.isascii() or max(word) < "ɐ")


class Encoder:
    """``encode(texts)``: the token ids of each text, as little-endian unsigned 32-bit integers.

    The distinct chunks of a batch are encoded in one call and laid out by their numbers.
    """

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after another, and where each begins."""
        plain = np.array([_plain(c) for c in chunks], bool)
        # the same merges in a quicker library; elsewhere the two may class characters apart
        joined = _MARK.join([*(c for c, p in zip(chunks, plain, strict=True) if p), ""])
        ranks = np.array(self.vocab.quick.encode_ordinary(joined), np.int64)
        ends = np.flatnonzero(ranks == ord(_MARK))
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain] = np.diff(np.concatenate([[-1], ends])) - 1
        rest = {i: self.vocab.library.encode(chunks[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain).tolist()}
        for i, own in rest.items():
            sizes[i] = len(own)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(starts[-1], "<u4")
        quick = np.repeat(plain, sizes)
        out[quick] = self.vocab.of_rank[ranks[ranks != ord(_MARK)]]
        out[~quick] = np.concatenate([np.empty(0, "<u4"), *rest.values()]) if rest else 0
        return out, starts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.vocab.segments(t) for t in texts]
        chunks, which, begins = batch_chunks([p for own in parts for p in own[::2]])
        flat, ends = runs(*self._chunks(chunks), which)
        found = iter(np.split(flat, ends[begins[1:-1]])) if parts else iter(())
        out = []
        for own in parts:
            ids = [next(found) if i % 2 == 0 else np.array([self.vocab.special[p]], "<u4") for i, p in enumerate(own)]
            out.append(np.concatenate(ids) if len(ids) > 1 else ids[0])
        return out


def encoder(path: str) -> Encoder:
    """One copy for each Python worker."""
    return of_worker(("encoder", path), lambda: Encoder(path))
