import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from llm.conftest import ODD_TEXTS
from sparkfill.llm import substring


def brute(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    line = lambda n: [word() for _ in range(n)]
    a, b, c = line(60), line(35), line(34)
    docs = [line(rng.randrange(10)) + p[rng.randrange(8) :] + line(rng.randrange(40)) for p in (a, b, c, a, a, b, c, c) for _ in range(2)]
    docs += [a + line(3) + a, ["la"] * 90, ["x", "y"] * 40, b[:20] + ["other"] + b[20:], b + b, line(200), a + b, b + a]
    docs += [docs[0], docs[1], b, c]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("hot", [3, 5000])
def test_equals_brute_force(make_docs, hot):
    texts = passages() + ODD_TEXTS + ["  ".join(passages()[0].split()), "é ü " * 40]
    rows = [*enumerate(texts), (0, texts[0]), (3, texts[5]), (None, texts[0]), (None, texts[0]), (None, None)]
    got = sorted(map(tuple, substring.digest(make_docs(rows), hot=hot).collect()), key=str)
    assert got == brute(rows)


def test_smaller_windows(make_docs):
    rows = [*enumerate(passages())]
    got = sorted(map(tuple, substring.digest(make_docs(rows), window=10, k=4).collect()), key=str)
    assert got == brute(rows, 10)


def test_empty_table(make_docs):
    assert substring.digest(make_docs(["a"]).limit(0)).count() == 0


def test_kept_text(make_docs):
    shared = " ".join(f"s{i}" for i in range(40))
    changed, same = substring.remove_repeats(make_docs([f"a {shared} b", f"{shared} c", "clean"]))
    assert {r.doc_id: r.kept for r in changed.collect()} == {0: "a b", 1: "c"}
    assert [r.doc_id for r in same.collect()] == [2]


def test_overlapping_segments_are_one_place(make_docs):
    rng = random.Random(7)
    fresh = iter(range(10**6))
    line = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    docs = []
    for _ in range(30):
        again = line(8)
        docs.append(line(rng.randrange(60)) + again + line(rng.randrange(1, 19)) + again + line(rng.randrange(60)))
        docs.append(line(rng.randrange(40)) + ["same"] * 20 + line(rng.randrange(40)))
        docs.append(line(rng.randrange(40)) + ["same"] * 20 + line(rng.randrange(1, 7)) + ["same"] * 20 + line(rng.randrange(40)))
        docs.append(line(5) + again + line(rng.randrange(9, 19)) + again + line(5))  # both segments are the whole text
    rows = [*enumerate(" ".join(d) for d in docs)]
    expected = brute(rows)
    assert not any(n_removed for _, _, n_removed, _ in expected)
    got = sorted(map(tuple, substring.digest(make_docs(rows)).collect()), key=str)
    assert got == expected


def test_places_of_one_document_recur(make_docs):
    a = [f"a{i}" for i in range(50)]
    rows = [*enumerate([" ".join(a + a), " ".join(["z"] * 36), " ".join(["y"] * 35), " ".join(f"c{i}" for i in range(60))])]
    got = sorted(map(tuple, substring.digest(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert [r[2] for r in got] == [100, 36, 0, 0]


def test_grams_of_a_slice_are_hashed_at_once(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(n)) for n in (0, 3, 34, 35, 36, 200, 61)]
    calls, whole = [], substring.ngram_hashes

    def hashes(*args):
        calls.append(args)
        return whole(*args)

    monkeypatch.setattr(substring, "ngram_hashes", hashes)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(7), "text_key": range(7), "text": texts})
    (got,) = substring._find_anchors(35, 8)(iter([batch]))
    assert len(calls) == 1
    for text, at, values in zip(texts, got.column("at").to_pylist(), got.column("anchor").to_pylist()):
        own = substring.hashed_words([text])[0]
        assert at == substring.anchors(own, 35).tolist() and values == whole(own, 8)[at].view("int64").tolist()


def test_a_phrase_is_not_matched_word_by_word():
    shard = substring._Shard(3)
    shard.add([((1, 1, 1), 5, b"a b c d"), ((2, 2, 2), 0, b"a b c d"), ((3, 3, 3), 0, b"x b c d y"), ((4, 4, 4), 7, b"x y z x")])
    seen = []

    class Automaton:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            return getattr(self.of, name)

        def __len__(self):
            return len(self.of)

        def iter(self, letters):
            seen.append(len(letters))
            return self.of.iter(letters)

    shard.automaton = Automaton(shard.automaton)
    assert sorted(shard.spans()) == [((1, 1, 1), 5, 9), ((2, 2, 2), 0, 4), ((3, 3, 3), 1, 4)]
    assert sorted(seen) == [4, 5]
