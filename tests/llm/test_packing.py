import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ODD_TEXTS
from sparkfill.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def verify(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for d, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        first = len(ids) % capacity or capacity
        assert [r.piece for r in own] == list(range(len(own))) and [r.length for r in own] == [first] + [capacity] * ((len(ids) - first) // capacity)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin), sum(r.length for r in rows)


@pytest.mark.parametrize(("capacity", "group"), [(2048, 4096), (32, 16)])
def test_round_trip_and_fill(make_docs, real_docs, capacity, group):
    for docs in (real_docs, make_docs(ODD_TEXTS)):
        texts = {r.doc_id: r.text for r in docs.collect()}
        bins, total = verify(packing.pack_documents(docs, capacity, group=group).collect(), texts, capacity)
        assert bins <= total / capacity * 1.05 + 2


def test_repeated_rows_null_ids_and_empty(make_docs):
    rows = packing.pack_documents(make_docs([(1, "a b c"), (1, "a b c"), (None, None)])).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0
    assert len({r.offset for r in rows}) == 3
    assert packing.pack_documents(make_docs(["a"]).limit(0)).count() == 0


def test_local_search_raises_fill():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(600, 1100, 1500), rng.integers(1, 40, 999), np.full(50, 1025), np.array([5])):
        bins = packing.best_fit(lengths, 2048)
        better = packing.local_search(bins, lengths, 2048)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        assert max(lengths[b].sum() for b in better) <= 2048 and len(better) <= len(bins)
    lengths = rng.integers(600, 1100, 1500)
    assert len(packing.local_search(packing.best_fit(lengths, 2048), lengths, 2048)) < len(packing.best_fit(lengths, 2048))


def test_search_goes_on_until_no_bin_can_give():
    rng = np.random.default_rng(7)
    lengths = rng.integers(501, 1100, 600)
    bins = packing.best_fit(lengths, 2048)
    packed = packing.local_search(bins, lengths, 2048)
    assert sorted(i for b in packed for i in b) == list(range(600)) and all(lengths[b].sum() <= 2048 for b in packed)
    assert -(-lengths.sum() // 2048) <= len(packed) < len(bins)
