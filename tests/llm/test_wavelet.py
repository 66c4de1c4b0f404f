import random
import tracemalloc
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.conftest import ODD_TEXTS
from sparkfill.llm import wavelet
from sparkfill.llm.text import running_total
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_as_the_library_has_them():
    rng = random.Random(2)
    parts = ["a", "The", "'s", "'l", "'LL", "'", " ", "  ", "\n", "\t", "!", "é", "É", "字", "1", "23", "\x85", "\x1c", "\x01", "😀", "İ", "ªº²",
             "<|endoftext|>", "<|endof", "<|startoftext|>", "Σ", "ΑΣ", "x", "　", "́", "K", "Å", "ﬁ", " ", "\xa0", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + [t or "" for t in ODD_TEXTS]
    texts += ["".join(chr(rng.randrange(33, 0x250)) for _ in range(rng.randrange(9))) for _ in range(4000)]
    enc = wavelet.WordEncoder(wavelet.DEFAULT)
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        assert [x.tolist() for x in enc.encode(some)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in some]
    assert enc.encode([]) == [] and [x.tolist() for x in enc.encode(["", "", "字"])] == [[], [], LIBRARY.encode("字", add_special_tokens=False).ids]


@pytest.mark.parametrize("n,bits", [(0, 3), (1, 1), (7, 4), (512, 16), (5000, 16), (4097, 2)])
def test_matrix_against_the_sequence(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << bits, n).astype(np.uint16)
    ids[: n // 3] = ids[0] if n else 0  # a hot id
    m = wavelet.WaveletMatrix.build(ids, bits)
    m = wavelet.WaveletMatrix(m.n, m.zeros, [p.tobytes() for p in m.planes], [r.astype("<u4").tobytes() for r in m.ranks])
    assert m.decode().tolist() == ids.tolist()
    at = rng.integers(0, n, min(n, 300)) if n else np.empty(0, np.int64)
    assert m.access(at).tolist() == ids[at].tolist()
    for token in {*ids[:40].tolist(), 0, (1 << bits) - 1, 1 << bits, -1}:
        places = np.flatnonzero(ids == token)
        ends = [0, n, *at.tolist()]
        assert m.rank(token, ends).tolist() == [int((ids[:e] == token).sum()) for e in ends]
        assert m.positions(token).tolist() == places.tolist()
        with pytest.raises(IndexError):
            m.select(token, len(places))


def check(spark, docs, rows, **options):
    """``rows``: (id, text) in the order that the files must have."""
    path = wavelet.write_tokens(docs, **options)
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    ids = [ids_of(t) for _, t in rows]
    starts = [0, *accumulate(map(len, ids))]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [
        (d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), s, i in zip(rows, starts, ids)]
    return path, starts, ids


def test_odd_documents_round_trip(spark, make_docs):
    rows = list(enumerate(ODD_TEXTS))
    for options in ({}, {"file_bytes": 50}, {"file_bytes": 50, "shard_tokens": 3}, {"shard_tokens": 1}):
        path, starts, ids = check(spark, make_docs(rows[::-1]), rows, **options)
        for token in (1, ids[4][0], 40000):
            want = [(d, s, i.count(token)) for d, (s, i) in enumerate(zip(starts, ids)) if token in i]
            assert sorted(map(tuple, wavelet.count_token(spark, path, token).collect())) == want
            want = [(d, s, p) for d, (s, i) in enumerate(zip(starts, ids)) for p, t in enumerate(i) if t == token]
            assert sorted(map(tuple, wavelet.find_token(spark, path, token).collect())) == want


def test_null_and_repeated_ids(spark, make_docs):
    rows = [(None, "x y")] * 5 + [(-3, "")] + [(7, "again and again")] * 40 + [(9, None)]
    docs = make_docs(rows[::-1])
    check(spark, docs, rows, file_bytes=60, shard_tokens=20)
    two = make_docs([(1, "first"), (1, "second text"), (2, "z")])
    got = sorted(wavelet.read_documents(spark, wavelet.write_tokens(two)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 1, 2] and got[2].start == got[0].n_tokens + got[1].n_tokens


def test_empty_table(spark, make_docs):
    path = wavelet.write_tokens(make_docs(["a"]).limit(0))
    assert wavelet.read_documents(spark, path).collect() == [] and wavelet.find_token(spark, path, 1).collect() == []


def test_very_long_text(spark, make_docs):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(1_000_000))
    assert len(long) > 4_000_000
    check(spark, make_docs([(1, "before"), (2, long), (3, "after")]), [(1, "before"), (2, long), (3, "after")], shard_tokens=1000)


def test_memory_of_a_shard():
    """Encoding and reading hold a small multiple of a shard (12.8 bytes a byte of text before, and all planes copied)."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(350)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts), pa.array([0] * 4000, pa.int64())], names=["doc_id", "text", "part"])
    wavelet.word_encoder(wavelet.DEFAULT)
    tracemalloc.start()
    try:
        rows = list(wavelet._shard_rows(wavelet.DEFAULT, 1, wavelet.SHARD_TOKENS)([batch]))
        assert tracemalloc.get_traced_memory()[1] < 11 * sum(map(len, texts))
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        [(r, m)] = wavelet._each(rows)
        assert r["doc_ids"] == list(range(4000)) and tracemalloc.get_traced_memory()[1] - before < m.n
    finally:
        tracemalloc.stop()


def test_real_documents(spark, real_docs):
    rows = sorted((r.doc_id, r.text) for r in real_docs.collect())
    check(spark, real_docs, rows, file_bytes=20_000, shard_tokens=10_000)


def test_running_total_over_many_parts(spark):
    rows = [(p, o, (p * 7 + o) % 11) for p in range(0, 300, 3) for o in range(p % 4 + 1)]
    df = spark.createDataFrame(rows, "p long, o long, v long")
    got = sorted((r.p, r.o, r.before) for r in running_total(df, "p", "o", "v", wide=16).collect())
    want, total = [], 0
    for p, o, v in sorted(rows):
        want.append((p, o, total))
        total += v
    assert got == want
