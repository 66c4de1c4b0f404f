"""Operator 7, best-fit packing: best fit, then a swap-based local search.

Documents become token sequences that end with a separator. Only those longer than a
sequence are cut: all pieces but the first are full. Full pieces are sequences of their
own. The rest (one piece a document at most) are dealt by a hash of their key into groups
of bounded size, and each group is packed in one task: best fit by falling length, then
an exchange of one piece for one, of two for one, or a move, between bins that are not
full, whenever it raises the sum of squared fills. So the emptier bin of two gets emptier
until it is empty and goes. The bins that a group leaves least full are few; their pieces
meet those of other groups in a second, smaller deal.

Only lengths, ids and check sums are shuffled, never tokens.

Defined results: a null or empty text is the separator alone, one piece of length 1; a
null id stays null; repeated rows are packed as rows of their own; an empty table gives
an empty table. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfill.llm.bpe import encoder
from sparkfill.llm.text import slices, two_columns
from sparkfill.session import cut_lineage

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces packed together in one task.
GROUP = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = pa.schema([*_PIECES, ("bin", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64())])


def pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = DEFAULT, separator: int = 0) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``."""

    def cut(batches):
        enc, end = encoder(tokenizer), np.array([separator], "<u4")
        for batch in slices(batches, most=4_000_000):
            rows, found = [], enc.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = np.concatenate([ids, end])
                n = len(ids)
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + capacity if k else first
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[start:stop])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return two_columns(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of places in ``lengths``: longest first, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room left
    rooms = 0  # bit r is set if a bin with room r is open
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _options(place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a bin can give back: nothing, one of its pieces, or two that are next in length.

    Returns rows (first piece or -1, second piece or -1), their bins and their lengths.
    """
    order = np.lexsort((lengths, place))
    order = order[place[order] >= 0]
    a, b = order[:-1], order[1:]
    same = place[a] == place[b]
    a, b = a[same], b[same]
    held = np.unique(place[order])
    none = np.full(len(held), -1)
    out = np.stack([np.concatenate([none, order, a]), np.concatenate([none, np.full(len(order), -1), b])], axis=1)
    bins = np.concatenate([held, place[order], place[a]])
    back = np.concatenate([np.zeros(len(held), lengths.dtype), lengths[order], lengths[a] + lengths[b]])
    return out, bins, back


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges between bins that are not full, to empty the emptiest ones.

    The emptiest bin gives: a piece moves to another bin that has room for it, or is
    exchanged for a shorter piece there, or for two that are shorter together; the change
    that raises the sum of squared fills most for that piece is made. A bin from which
    nothing can be given any more is left as it is; the search ends when the other bins
    have less room than the emptiest holds, or when no bin can give anything. Every change
    raises the sum, so it ends.
    """
    place = np.full(len(lengths), -1)
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    for k, members in enumerate(bins):
        if fill[k] < capacity:
            place[members] = k
    stuck = np.zeros(len(bins), bool)
    while True:
        live = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(live):
            break
        giver = live[np.argmin(fill[live])]
        room = np.where((fill > 0) & (fill < capacity), capacity - fill, 0)
        room[giver] = 0
        if room.sum() < fill[giver]:
            break
        given = False
        others = np.where(place == giver, -1, place)
        out, at, back = _options(others, lengths)
        for i in sorted(np.flatnonzero(place == giver), key=lambda i: -lengths[i]):
            gain = lengths[i] - back
            # squared fill rises by 2 * gain * (fill of the taker - fill of the giver + gain)
            worth = np.where((gain > 0) & (gain <= room[at]), gain * (fill[at] - fill[giver] + gain), 0)
            if not len(worth) or worth[best := int(np.argmax(worth))] <= 0:
                continue
            taker, g = at[best], gain[best]
            place[i] = taker
            place[[j for j in out[best] if j >= 0]] = giver
            fill[taker] += g
            fill[giver] -= g
            room[taker] = 0  # its pieces have changed; it takes again in the next turn
            given = True
        if fill[giver] and not given:
            stuck[giver] = True
    full = [members for k, members in enumerate(bins) if fill[k] == capacity and place[members[0]] < 0]
    order = np.argsort(place, kind="stable")
    order = order[place[order] >= 0]
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    return full + [part.tolist() for part in np.split(order, cuts) if len(part)]


def _pack_group(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")]
        table = table.select(_PIECES.names).sort_by(order)  # so that a task run again deals alike
        lengths = table["length"].to_numpy().astype(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        bin_, offset, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, members in enumerate(bins):
            own = lengths[members]
            bin_[members], offset[members], filled[members] = k, np.cumsum(own) - own, own.sum()
        return table.append_column("bin", pa.array(bin_)).append_column("offset", pa.array(offset)).append_column("filled", pa.array(filled)).cast(_PACKED)

    return pack


def _deal(parts: DataFrame, n_groups: int, capacity: int, salt: int) -> DataFrame:
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(salt)), F.lit(n_groups))
    return parts.withColumn("part", key).groupBy("part").applyInArrow(
        lambda k, t: _pack_group(capacity)(t).append_column("part", pa.array([k[0].as_py()] * t.num_rows, pa.int64())),
        PIECES + ", bin long, offset long, filled long, part long",
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str = DEFAULT, separator: int = 0, group: int = GROUP, well_filled: float = 0.9) -> DataFrame:
    """Deal all documents into sequences of at most ``capacity`` tokens.

    Returns :func:`pieces` with ``sequence_id`` and ``offset``. Groups hold about ``group``
    documents. Pieces of bins filled less than ``well_filled`` are dealt once more; the
    first deal is written to the shared folder, so texts are encoded once.
    """
    parts = pieces(docs, capacity, id_col, text_col, tokenizer, separator)
    first = cut_lineage(_deal(parts, max(1, -(-docs.count() // group)), capacity, 0))
    short = F.col("filled") < F.lit(well_filled * capacity)
    again = first.where(short)
    second = _deal(again.select(*_PIECES.names), max(1, -(-again.count() // group)), capacity, 1)
    place = (F.col("part") * F.lit(1 << 32) + F.col("bin")) * 2
    both = first.where(~short).withColumn("sequence_id", place).unionByName(second.withColumn("sequence_id", place + 1))
    return both.select(*_PIECES.names, "sequence_id", "offset")
