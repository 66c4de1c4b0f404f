import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F
from sparkfill.llm import decontaminate
from sparkfill.llm.text import folded_words

ITEMS = [(1, "One two, three four five six seven eight nine ten eleven TWELVE"), (2, "short item"), (10, "short ITEM!"), (3, ""), (4, None), (5, "..."),
         (6, "la " * 12), (7, "été à la plage avec les enfants et le chien noir"), (8, "one two three four five six seven eight nine ten")]


def brute(texts, items, window=10):
    out = {}
    for d, t in texts:
        words, hit, found = folded_words(t), set(), set()
        for item, text in items:
            own = folded_words(text)
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(item)
        out[d] = (len(words), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1))


TEXTS = [*ODD_TEXTS, "x one two three FOUR five six seven eight nine ten y", "one two three four five six seven eight nine", "a short item and a short-item",
         "la " * 40, "ÉTÉ à la plage avec les enfants et le chien noir", "été à la plage avec les enfants et le chien noir one two three four five six seven eight nine ten eleven twelve",
         "one two three four five six seven eight nine ten " * 3]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40}, {"shard_bytes": 30}])
def test_equals_brute_force(make_docs, items, options):
    want = brute(enumerate(TEXTS), ITEMS)
    for r in decontaminate.find_overlaps(make_docs(TEXTS), items, **options).collect():
        assert (r.n_words, sum(s.stop - s.start for s in r.spans), list(r["items"])) == want[r.doc_id], TEXTS[r.doc_id]


def test_longest_match(make_docs, items):
    got = {r.doc_id: r.longest for r in decontaminate.find_overlaps(make_docs(TEXTS), items).collect()}
    n = len(ODD_TEXTS)
    assert [got[n + i] for i in range(7)] == [10, 0, 2, 12, 10, 12, 10]


def test_removal_keeps_whole_rows(make_docs, items):
    docs = make_docs([(1, TEXTS[-1]), (1, "clean"), (None, "clean"), (None, "a short item"), (5, None)])
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", "clean"), ("5", "None"), ("None", "clean")]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 5
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
