"""Operator 10, toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding, if the sample has it often enough, plus the mean
embedding of its hashed character trigrams. Two gated recurrent layers read a window of
words forwards and backwards; attention pools their states, and a linear layer gives the
window's score. Windows overlap, all of a text are scored, and a document has the score of
its worst window. Training is the same: the worst window of a document carries its label
back through time. Gates use ``x / (1 + |x|)``, which is quick and smooth enough.

The network is fitted on the driver on a bounded sample of labelled documents (``per_class``
a class, of up to ``longest`` characters); it is a few hundred kilobytes when broadcast.

Defined results: a text without words has the score of an empty window, that of the clean
class's prior; without labelled documents every score is 0; a null id is not held out and
stays null; repeated rows get equal scores; an empty table gives an empty table. ``reject``
returns whole rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.labels import held_out, labelled_sample
from sparkfill.llm.text import folded_words, of_worker, slices

WINDOW, STRIDE = 64, 48
TRIGRAMS = 8192
_DIRECTIONS = ("f", "b")


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * soft(x)


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words, blanks around, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(15)
    begins = np.cumsum(lengths + 2) - lengths - 2
    inside = np.ones(len(ids), bool)
    if len(begins) > 1:  # what spans two words
        inside[begins[1:] - 2], inside[begins[1:] - 1] = False, False
    starts = np.cumsum(lengths) - lengths
    return (ids & np.uint32(TRIGRAMS - 1))[inside], starts


class _Numbers(dict):
    """Numbers words as they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), np.int64)


class _Lexicon:
    """Distinct words with what a network looks up for them: their numbers in its vocabulary, and their trigrams."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        self.own = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
        self.ids, self.starts = _trigrams(words) if words else (np.empty(0, np.uint32), np.empty(0, np.int64))
        self.counts = np.diff(np.append(self.starts, len(self.ids)))

    def take(self, places: np.ndarray) -> _Lexicon:
        """The words at ``places`` alone."""
        part = object.__new__(_Lexicon)
        part.own, part.counts = self.own[places], self.counts[places]
        part.starts = np.cumsum(part.counts) - part.counts
        part.ids = self.ids[np.repeat(self.starts[places] - part.starts, part.counts) + np.arange(part.counts.sum())]
        return part


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Where the windows of ``n`` words start; the last one ends with the text."""
    if n <= size:
        return [0]
    return [*range(0, n - size, stride), n - size]


@dataclass
class Network:
    """Parameters, by name, and the vocabulary."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, words: _Lexicon) -> np.ndarray:
        """The embedding of each word, and zeros below them for padding."""
        dim = self.p["word"].shape[1]
        if not len(words.own):
            return np.zeros((1, dim), np.float32)
        chars = np.add.reduceat(self.p["char"][words.ids], words.starts, axis=0) / words.counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][words.own] + chars, np.zeros((1, dim), np.float32)])

    def states(self, x: np.ndarray, live: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (time, window, unit) of one direction; ``x`` has the words' shares of the gates.

        ``tape`` gets for each step the state before it and that state's share of the gates.
        """
        u, steps, k = self.p["U" + d], x.shape[0], self.p["U" + d].shape[0]
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((steps, x.shape[1], k), np.float32)
        before = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            before[t] = (h, hu)
            g = _gate(x[t, :, : 2 * k] + hu[:, : 2 * k])
            n = soft(x[t, :, 2 * k :] + g[:, k:] * hu[:, 2 * k :])
            out[t] = h = h + live[t][:, None] * g[:, :k] * (n - h)
        if tape is not None:
            tape.extend(map(np.stack, zip(*before, strict=True)))
        return out

    def pool(self, hf: np.ndarray, hb: np.ndarray, live: np.ndarray):
        """Attention over time: logits of the windows, and what the way back needs."""
        s = hf @ self.p["af"] + hb @ self.p["ab"]
        s = np.where(live > 0, s, -1e9)
        e = np.exp(s - s.max(axis=0)) * live
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pf, pb = np.einsum("tw,twh->wh", alpha, hf), np.einsum("tw,twh->wh", alpha, hb)
        return pf @ self.p["of"] + pb @ self.p["ob"] + self.p["bias"][0], (alpha, pf, pb)

    def logits(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """``x``: (time, window, embedding)."""
        hf, hb = (self.states(x @ self.p["W" + d] + self.p["c" + d], live, d) for d in _DIRECTIONS)
        return self.pool(hf, hb, live)[0]

    def gradients(self, x: np.ndarray, live: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean cross entropy: by parameter, and by input; and the loss."""
        p, g = self.p, {}
        tapes = {"f": [], "b": []}
        gates = {d: x @ p["W" + d] + p["c" + d] for d in _DIRECTIONS}
        h = {d: self.states(gates[d], live, d, tapes[d]) for d in _DIRECTIONS}
        logit, (alpha, pf, pb) = self.pool(h["f"], h["b"], live)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d_logit = ((prob - labels) / len(labels)).astype(np.float32)
        loss = float(-np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9)))
        g["bias"] = np.array([d_logit.sum()], np.float32)
        pooled, dx = {"f": pf, "b": pb}, np.zeros_like(x)
        d_alpha = sum(h[d] @ p["o" + d] for d in _DIRECTIONS) * d_logit
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        for d in _DIRECTIONS:
            g["o" + d] = pooled[d].T @ d_logit
            g["a" + d] = np.einsum("tw,twh->h", d_s, h[d])
            dh_out = alpha[:, :, None] * (d_logit[:, None] * p["o" + d])[None] + d_s[:, :, None] * p["a" + d]
            k, u_back = p["U" + d].shape[0], np.ascontiguousarray(p["U" + d].T)
            h0, hu = tapes[d]
            a = gates[d][:, :, : 2 * k] + hu[:, :, : 2 * k]
            z, r = np.split(_gate(a), 2, axis=2)
            b = gates[d][:, :, 2 * k :] + r * hu[:, :, 2 * k :]
            slope_z, slope_r = np.split(0.5 / (1 + np.abs(a)) ** 2, 2, axis=2)
            kept = live[:, :, None] * z
            d_new = kept / (1 + np.abs(b)) ** 2
            # what reaches the update gate, the reset gate and the new state's share is the state's gradient times these
            times = np.stack([live[:, :, None] * (soft(b) - h0) * slope_z, d_new * hu[:, :, 2 * k :] * slope_r, d_new * r], axis=2)
            d_hu, dhs, dh = np.empty_like(times), np.empty_like(h0), np.zeros_like(h0[0])
            stays = 1 - kept
            for t in range(len(h0) - 1, -1, -1) if d == "f" else range(len(h0)):
                dhs[t] = dh = dh + dh_out[t]
                np.multiply(dh[:, None, :], times[t], out=d_hu[t])
                dh = dh * stays[t] + d_hu[t].reshape(len(dh), 3 * k) @ u_back
            gx = np.concatenate([d_hu[:, :, 0], d_hu[:, :, 1], dhs * d_new], axis=2).reshape(-1, 3 * k)
            g["U" + d] = h0.reshape(-1, k).T @ d_hu.reshape(-1, 3 * k)
            g["W" + d], g["c" + d] = x.reshape(-1, x.shape[2]).T @ gx, gx.sum(axis=0)
            dx += (gx @ p["W" + d].T).reshape(x.shape)
        return g, dx, loss

    def document_logits(self, texts: list[list[bytes]], size: int = WINDOW, stride: int = STRIDE, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, the largest logit of its windows, and where that window starts."""
        numbers = _Numbers()
        rows = [numbers.of(words) for words in texts]
        return self.worst_windows(self.inputs(_Lexicon(list(numbers), self.vocabulary)), rows, size, stride, most)

    def worst_windows(self, x: np.ndarray, rows: list[np.ndarray], size: int = WINDOW, stride: int = STRIDE, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`document_logits`, of documents as rows of places in ``x``, whose last row is padding."""
        best, at = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        none = len(x) - 1
        gates = {d: x @ self.p["W" + d] + self.p["c" + d] for d in _DIRECTIONS}
        doc = [d for d, r in enumerate(rows) for _ in windows(len(r), size, stride)]
        start = [s for r in rows for s in windows(len(r), size, stride)]
        flat = np.concatenate([*rows, np.full(size, none)])
        begin = np.cumsum([0, *map(len, rows)])
        doc, start = np.array(doc, np.int64), np.array(start, np.int64)
        length = np.minimum(size, np.diff(begin)[doc] - start) if len(doc) else start
        order = np.argsort(length, kind="stable")  # like lengths together, so that little is padding
        for i in range(0, len(order), most):
            part = order[i : i + most]
            steps = max(1, int(length[part].max()))
            place = np.arange(steps)[:, None]
            live = (place < length[part]).astype(np.float32)
            words = np.where(live > 0, flat[np.minimum(begin[doc[part]] + start[part] + place, len(flat) - 1)], none)
            hf, hb = (self.states(gates[d][words], live, d) for d in _DIRECTIONS)
            logit = self.pool(hf, hb, live)[0]
            for w, v in zip(part.tolist(), logit.tolist(), strict=True):
                if v > best[doc[w]]:
                    best[doc[w]], at[doc[w]] = v, start[w]
        return best, at


def _log_odds(present: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of occurring in a document of label 1 against 0; ``present`` is (document, feature)."""
    a, b = present[labels == 1].mean(axis=0), present[labels == 0].mean(axis=0)
    n = max(1, min((labels == 1).sum(), (labels == 0).sum()))
    return np.clip(np.log((a + 1 / n) / (b + 1 / n)), -3, 3).astype(np.float32)


def train(texts: list[str | None], labels: np.ndarray, units: int = 12, dim: int = 12, epochs: int = 8, batch: int = 48, rate: float = 0.02,
          updates: int = 240, least: int = 4, vocabulary: int = 8000, seed: int = 10) -> Network:
    """Fits the network in ``epochs``, more if they have fewer than ``updates`` batches.

    Embeddings start from log odds, the rest at random.
    """
    rng = np.random.default_rng(seed)
    words = [folded_words(t) for t in texts]
    labels = np.asarray(labels, np.float32)
    counts: dict[bytes, int] = {}
    for own in words:
        for w in set(own):
            counts[w] = counts.get(w, 0) + 1
    known = sorted((w for w, c in counts.items() if c >= least), key=lambda w: (-counts[w], w))[:vocabulary]
    vocab = {w: i + 1 for i, w in enumerate(known)}
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"word": 0.1 * small(len(vocab) + 1, dim), "char": 0.1 * small(TRIGRAMS, dim), "bias": np.array([-2.0], np.float32)}
    p["word"][0] = 0
    for d in _DIRECTIONS:
        p |= {"W" + d: small(dim, 3 * units), "c" + d: np.zeros(3 * units, np.float32), "U" + d: small(units, 3 * units),
              "a" + d: small(units), "o" + d: small(units)}
    net = Network(vocab, p)
    if not len(labels) or labels.min() == labels.max():
        p["bias"][0] = 20.0 if len(labels) and labels.min() == 1 else -20.0
        p["of"][:], p["ob"][:] = 0, 0
        return net
    seen_words, seen_chars = np.zeros((len(words), len(vocab) + 1), np.float32), np.zeros((len(words), TRIGRAMS), np.float32)
    for i, own in enumerate(words):
        seen_words[i, [vocab[w] for w in set(own) if w in vocab]] = 1
        if own:
            seen_chars[i, _trigrams(list(set(own)))[0]] = 1
    p["word"][1:, 0] = _log_odds(seen_words, labels)[1:]
    p["char"][:, 0] = _log_odds(seen_chars, labels)
    del seen_words, seen_chars
    numbers = _Numbers()
    rows = [numbers.of(own) for own in words]
    lexicon = _Lexicon(list(numbers), vocab)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, epochs = 0, max(epochs, -(-updates // max(1, -(-len(words) // batch))))
    for epoch in range(epochs):
        order = rng.permutation(len(words))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            own = [rows[j] for j in part]
            met, places = np.unique(np.concatenate(own), return_inverse=True)
            local = lexicon.take(met)
            own = np.split(places, np.cumsum([len(r) for r in own])[:-1])
            table = net.inputs(local)
            _, at = net.worst_windows(table, own)
            chosen = [w[s : s + WINDOW] for w, s in zip(own, at.tolist(), strict=True)]
            place = np.full((max(1, max(map(len, chosen))), len(chosen)), len(met))
            for k, c in enumerate(chosen):
                place[: len(c), k] = c
            live = (place < len(met)).astype(np.float32)
            g, dx, _ = net.gradients(table[place], live, labels[part])
            used, place = np.unique(place, return_inverse=True)
            d_table = np.zeros((len(used), dim), np.float32)
            np.add.at(d_table, place, dx)
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            used = local.take(used[used < len(met)])
            d_table = d_table[: len(used.own)]  # without padding
            np.add.at(g["word"], used.own, d_table)
            g["word"][0] = 0
            np.add.at(g["char"], used.ids, np.repeat(d_table / used.counts[:, None].astype(np.float32), used.counts, axis=0))
            step += 1
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 2000, longest: int = 10_000, **options) -> Network:
    """Trains on a sample of at most ``2 * per_class`` texts of at most ``longest`` characters."""
    sample = labelled_sample(docs, labels, label_col, per_class, longest).toArrow().sort_by("doc_id")
    return train(sample["text"].to_pylist(), sample["label"].to_numpy(), **options)


def _scorer(sent, text: str = "text"):
    """Scores beside the first column; ``text`` is a column, or a field of the first one."""
    def score(batches):
        net = of_worker("toxicity", lambda: None) or sent.value
        for batch in slices(batches, text, most=1_000_000):
            own = batch.column(text) if text in batch.schema.names else batch.column(0).field(text)
            logits, _ = net.document_logits([folded_words(t) for t in own.to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64))], names=[batch.schema.names[0], "score"])

    return score


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Returns ``doc_id, held_out, score`` for every document."""
    own = _own(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit(own, labels, **options))
    scored = own.mapInArrow(_scorer(sent), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def reject(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that score ``limit`` or more; whole rows stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(_own(docs, id_col, text_col), labels, **options))
    row = f"row_with_{text_col}"
    rows = docs.select(F.struct("*").alias(row))
    score: Column = F.col("score") < limit
    return rows.mapInArrow(_scorer(sent, text_col), f"`{row}` {rows.schema[row].dataType.simpleString()}, score double").where(score).select(F.col(f"`{row}`.*"))
