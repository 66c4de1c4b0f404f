import random

import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F
from sparkfill.llm import jaccard
from sparkfill.llm.graph import connected_components


def grams(text, n=5):
    words = (text or "").encode().split()
    k = min(n, len(words)) or 1
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, threshold=0.8):
    """doc -> (class, links, copies) for rows of (id, text)."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links, copies = [0] * len(rows), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            inter = len(a & b)
            if a == b or inter >= threshold * (len(a) + len(b) - inter) - 1e-9 and inter:
                links[i] += 1
                links[j] += 1
                if a == b:
                    copies[i] += 1
                    copies[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, name[find(i)], links[i], copies[i]) for i, (d, _) in enumerate(rows)), key=str)


def planted(seed, n_base=6, copies=14, words=60, changes=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(words)] = f"x{rng.randrange(9)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_classes_and_links_equal_brute_force(make_docs, block):
    texts = planted(1) + ODD_TEXTS + ["a b c", "a b c d e", "a b c d e"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, "only here and without an id")]
    got = sorted(map(tuple, jaccard.near_duplicates(make_docs(rows), block=block).collect()), key=str)
    assert got == brute(rows)


def test_real_documents(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    assert sorted(map(tuple, jaccard.near_duplicates(real_docs).collect()), key=str) == brute(rows)


def test_keep_one(make_docs):
    rows = [(i, t) for i, t in enumerate(planted(2, copies=3) + ["", None, "clean text of its own"])] + [(0, planted(2)[0])] * 2
    docs = make_docs(rows)
    want = sorted({c for _, c, _, _ in brute(rows)})
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_bands_reach_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).where(F.lit(True)).count() == 0
