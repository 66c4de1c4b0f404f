import hashlib

from pyspark.sql import functions as F
from sparkfill.llm import fingerprint as fp


def edited(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = [r.text or "" for r in rows]
    out = {}
    for i, r in enumerate(rows):
        nxt, n = texts[(i + 1) % len(rows)], len(texts[i])
        out[r.doc_id] = texts[i][: n - n // 2] + nxt[: n // 2]
    return out


def test_edited_texts_and_next(make_docs, real_docs):
    odd = make_docs([(5, "é" * 9), (-3, None), (10**15, "a b c d e f g h i"), (7, "x y z"), (8, "")])
    for docs, group in ((odd, 2), (odd, 4096), (odd.limit(1), 10), (real_docs, 16), (real_docs, 4096)):
        want = edited(docs)
        got = fp.edited_fingerprints(fp.fingerprints(docs).select("doc_id", "text")).collect() if group == 4096 else None
        pairs = fp.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], group).collect()
        assert len(pairs) == len(want)
        for r in pairs:
            n = len(r.text)
            assert r.text[: n - n // 2] + r.next_text[: n // 2] == want[r.doc_id]
        for r in got or []:
            assert r.edited == want[r.doc_id]


def test_winnowing_equals_brute_force(make_docs):
    import random
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 4, 5, 6, 20, 21, 60, 300)]
    docs = make_docs(texts)
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    # the hash of every k-gram, one at a time
    grams = {(d, i): " ".join(t.split()[i : i + fp.K]) for d, t in enumerate(texts) for i in range(max(1, len(t.split()) - fp.K + 1)) if t}
    flat = make_docs([(i, g) for i, g in enumerate(grams.values())])
    one = {r.doc_id: r.fingerprint[0] >> 31 for r in fp.fingerprints(flat).collect()}
    of = {key: one[i] for i, key in enumerate(grams)}
    for d, text in enumerate(texts):
        hs = [of[d, i] for i in range(sum(k[0] == d for k in of))]
        want = []
        for s in range(max(1, len(hs) - fp.WINDOW + 1)) if hs else []:
            part = range(s, min(len(hs), s + fp.WINDOW))
            best = min(part, key=lambda i: (hs[i], -i))
            if best not in want:
                want.append(best)
        assert [fp._POSITIONS - (p & fp._POSITIONS) for p in got[d]] == want


def test_likeness_and_equal_texts(make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "", None, "totally different words are in here"])
    rows = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1.0
    assert rows[2].near_next == 1.0 and rows[1].near_next == 0.0 and rows[3].near_next == 0.0
    assert fp.edited_fingerprints(docs.limit(0)).count() == 0


def test_shared_run_is_found(make_docs):
    shared = " ".join(f"s{i}" for i in range(fp.K + fp.WINDOW - 1))
    docs = make_docs([f"{'p ' * 30}{shared} q", f"other start {shared}{' r' * 9}"])
    a, b = (set(p >> 31 for p in r.fingerprint) for r in fp.fingerprints(docs).orderBy("doc_id").collect())
    assert a & b


def test_digest(real_docs, spark):
    from sparkfill.llm.queries import QUERIES
    out = QUERIES["op8_fingerprints"](spark, "/root/testdata/sf0.001")
    want = edited(real_docs)
    for r in out.collect():
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
