import corpus_pipeline
from llm.test_decontaminate import brute as contaminated
from llm.test_jaccard import brute as classes
from llm.test_packing import verify
from llm.test_secrets import base
from sparkfill.llm import toxicity
from sparkfill.session import read_table

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read_table(spark, DIR, "documents")
    items = [(r.item_id, r.text) for r in read_table(spark, DIR, "benchmark").collect()]
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, read_table(spark, DIR, "labels")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < 0.5]
    assert 0 < len(rows) < len(scores)
    kept = {c for _, c, _, _ in classes(rows)}
    rows = [(d, t) for d, t in rows if d in kept]
    found = contaminated(rows, items)
    rows = [(d, t) for d, t in rows if not found[d][1]]
    masked = {}
    for d, text in rows:
        out, at = "", 0
        for a, _, b, _ in base(text):
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        masked[d] = out + text[at:]
    packed = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in packed} == set(masked)
    verify(packed, masked, 2048)


def test_stages_keep_columns_and_take_odd_documents(spark, make_docs):
    docs = make_docs([None, "", "same words again in this one", "same words again in this one", "token = abcdefgh12", None])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.text for r in docs.collect()} in ({None, "same words again in this one", "[secret]"}, {"", "same words again in this one", "[secret]"})
