import zlib

import numpy as np
import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F
from sparkfill.llm import labels as L
from sparkfill.llm import quality, toxicity

DIR = "/root/testdata/sf0.1"


def accuracy(scored, labels, label, limit):
    own = scored.join(labels, "doc_id").where("held_out")
    right = F.avg(((F.col("score") >= limit) == (F.col(label) == 1)).cast("double"))
    return {r[label]: r.right for r in own.groupBy(label).agg(right.alias("right")).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_quality_of_held_out_documents(tables):
    got = accuracy(quality.score_quality(*tables), tables[1], "quality", 0.3)
    assert got[0] > 0.9 and got[1] > 0.98


def test_toxicity_of_held_out_documents(tables):
    # here junk has been written over the texts of quality 0, toxic ones too: their words are gone
    got = accuracy(toxicity.score_toxicity(*tables), tables[1].where("quality = 1"), "toxic", 0.5)
    assert got[0] > 0.97 and got[1] > 0.85  # few toxic documents in each language here


def test_fold_and_sample(spark, tables):
    ids = [0, 1, -5, 10**12, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(L.held_out(F.col("doc_id"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else False for i in ids]
    sample = L.labelled_sample(tables[0], tables[1], "toxic", 50).collect()
    assert len(sample) == 100 and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in sample)


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_odd_input(spark, make_docs, score, label):
    docs = make_docs([*enumerate(ODD_TEXTS), (1, ""), (None, "word")])
    known = [(i, i % 2, i % 2) for i in range(1, len(ODD_TEXTS))] + [(None, 1, 0), (3, None, None), (3, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    rows = score(docs, labels).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (0, 1)]
    assert len(same) == 3 and max(same) - min(same) < 1e-6
    assert score(docs, labels.limit(0)).count() == len(rows)
    assert score(docs.limit(0), labels).count() == 0


def test_reject_keeps_whole_rows(make_docs, spark):
    docs = make_docs([f"fine text number {i} here" if i % 2 else f"awful text number {i} here" for i in range(60)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    out = toxicity.reject(docs, labels)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(1, 60, 2))


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.train([f"w{i % 7} bad x" if i % 2 else f"w{i % 5} good a b" for i in range(40)], np.arange(40) % 2, epochs=1, least=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live, y = rng.standard_normal((5, 6, 12)), (rng.random((5, 6)) < 0.8).astype(float), (rng.random(6) < 0.5).astype(float)
    live[0] = 1
    grads, dx, _ = net.gradients(x, live, y)

    def loss():
        prob = 1 / (1 + np.exp(-net.logits(x, live)))
        return -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))

    for v, g in [(net.p[k], grads[k]) for k in ("Uf", "Ub", "Wf", "Wb", "cb", "af", "of", "bias")] + [(x, dx)]:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in v.shape)
            v[i] += 1e-4
            up = loss()
            v[i] -= 2e-4
            down = loss()
            v[i] += 1e-4
            assert abs((up - down) / 2e-4 - g[i]) < 1e-3


def test_windows_cover_and_overlap():
    for n in (0, 1, 64, 65, 100, 112, 113, 1000):
        starts = toxicity.windows(n)
        assert set().union(*(range(s, min(n, s + toxicity.WINDOW)) for s in starts)) == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))
