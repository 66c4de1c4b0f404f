"""Operator properties on small hand-made fixtures (FIXTURES.md section 4)."""
import math
import re

import pytest
from pyspark.sql import functions as F

from sparkfill.functions.ordered import dense_codes, exact_quantiles
from sparkfill.operators import clean, distance, encode, order, profile, sampling, score, synth
from sparkfill.operators.impute import registry, simple


@pytest.fixture(scope="module")
def tiny_nulls(spark):
    rows = [(1, 1.0, None, "a"), (2, None, None, None), (3, 3.0, None, "b"), (4, float("nan"), None, "a")]
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, c string")


def test_fill_keeps_observed_and_removes_nulls(spark, tiny_nulls):
    df = clean.sentinel_to_null(tiny_nulls, {}).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    out = simple.impute_constant(df, ["a", "c"], "mean").orderBy("row_id").collect()
    assert [r["a"] for r in out] == [1.0, 2.0, 3.0, 2.0]
    assert [r["c"] for r in out] == ["a", "a", "b", "a"]       # mode, ties to the least value
    assert out[0]["b"] is None                                  # all-null column stays null


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np
    vals = [float(x) for x in [5, 1, 1, 9, 3, 3, 3, 7, 2, 8, 10, 4]]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    import sparkfill.functions.ordered as O
    for limit in (O.EXACT_PERCENTILE_DISTINCT, 0):        # built-in path, then the bucketed path
        old, O.EXACT_PERCENTILE_DISTINCT = O.EXACT_PERCENTILE_DISTINCT, limit
        try:
            q = {r["g"]: r for r in exact_quantiles(df, "g", "x", probs).collect()}
        finally:
            O.EXACT_PERCENTILE_DISTINCT = old
        for g in (0, 1):
            arr = np.array([v for i, v in enumerate(vals) if i % 2 == g])
            for i, p in enumerate(probs):
                assert math.isclose(q[g][f"q{i}"], float(np.quantile(arr, p)), rel_tol=1e-12)


def test_dense_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    codes = {r["v"]: r["code"] for r in dense_codes(df, [], "v").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_ordinal_encode_rare_categories(spark):
    rows = [("x",)] * 79 + [("y",)] * 80 + [("z",)] * 81 + [(None,)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "row_id bigint, c string")
    enc, dims = encode.ordinal_encode(df, ["c"], 80)
    got = {r["c"]: r["c_code"] for r in enc.select("c", "c_code").distinct().collect()}
    assert got == {"y": 0, "z": 1, "x": 2, None: None}
    dec = {r["code"]: r["category"] for r in encode.decode_map(dims["c"]).collect()}
    assert dec[2] == encode.INFREQUENT


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.125,)], "x double")
    r = [row[0] for row in clean.round_to_code(df, ["x"]).collect()]
    assert r == [2, 4, -2, 0]


def test_sample_exact_n_is_exact_and_partition_free(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "row_id")
    a = {r[0] for r in sampling.sample_exact_n(df, 777, "t").collect()}
    b = {r[0] for r in sampling.sample_exact_n(df.repartition(13), 777, "t").collect()}
    assert len(a) == 777 and a == b
    sampling.FINAL_ROWS, old = 10, sampling.FINAL_ROWS      # force the second radix level
    try:
        c = {r[0] for r in sampling.sample_exact_n(df, 777, "t").collect()}
    finally:
        sampling.FINAL_ROWS = old
    assert c == a


def test_allocation_largest_remainder():
    assert sampling.allocate({0: 10, 1: 10, 2: 10}, 10) == {0: 4, 1: 3, 2: 3}
    assert sum(sampling.allocate({0: 7, 1: 2, 2: 1}, 5).values()) == 5


def test_nearest_code_ties_go_low(spark):
    vals = spark.createDataFrame([(1, 2.5), (2, 0.1), (3, 9.0), (4, None)], "row_id bigint, v double")
    codes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "area int")
    from sparkfill.operators.joins import nearest_code_join
    got = {r["row_id"]: r["code"] for r in nearest_code_join(vals, "v", codes, "area").collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 4.0, 4: None}


def test_nearest_group_matches_brute_force(spark):
    import random
    random.seed(1)
    rows = []
    for i in range(300):
        block = random.choice(["A", "B", None])
        code = random.choice([1, 2, 3]) if block == "A" else random.choice([4, 5])
        rows.append((i, block, code if random.random() > 0.2 else None, random.random() * 10,
                     random.choice(["p", "q", None])))
    df = spark.createDataFrame(rows, "row_id bigint, block string, code int, f1 double, f2 string")
    got = {r["row_id"]: r["best_code"] for r in distance.nearest_group(df, "row_id", "block", "code", ["f1"],
                                                                      ["block", "f2"]).collect()}
    known = [r for r in rows if r[2] is not None]
    block_codes = {}
    for r in known:
        if r[1] is not None:
            block_codes.setdefault(r[1], set()).add(r[2])
    for r in rows:
        if r[2] is not None:
            continue
        cands = block_codes.get(r[1]) or {k[2] for k in known}
        best = None
        for g in sorted(cands):
            mem = [k for k in known if k[2] == g]
            terms = []
            if r[3] is not None:
                ys = [k[3] for k in mem]
                rng = max(max(ys), r[3]) - min(min(ys), r[3])
                terms.append(sum(abs(r[3] - y) for y in ys) / len(ys) / rng if rng > 0 else 0.0)
            for idx in (1, 4):
                if r[idx] is not None:
                    vs = [k[idx] for k in mem if k[idx] is not None]
                    if vs:
                        terms.append(sum(1.0 for v in vs if v != r[idx]) / len(vs))
            s = sum(terms) / len(terms)
            if best is None or s < best[0] - 1e-12:
                best = (s, g)
        assert got[r[0]] == best[1]


def test_knn_top_k_ties_by_key(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(i)) for i in range(30)], "row_id bigint, x double, y double")
    q = df.where(F.col("row_id") == 0).select("row_id", "x")
    out = distance.gower_knn(df.where(F.col("row_id") != 0), q, "row_id", "y", ["x"], [], k=3).first()
    assert out["sum_near"] == 3.0 + 6.0 + 9.0      # x == 0 rows, lowest keys first


def test_elbow_offset_and_flat_curve(spark):
    curve = spark.createDataFrame([(k, float(v)) for k, v in zip(range(1, 11), [100, 40, 20, 15, 12, 10, 9, 8, 7, 6])],
                                  "k int, inertia double")
    r = order.elbow_k(curve).first()
    assert r["elbow_index"] == 2 and r["k"] == 4
    flat = spark.createDataFrame([(k, 5.0) for k in range(1, 11)], "k int, inertia double")
    assert order.elbow_k(flat).first()["k"] == 1


def test_macro_f1_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "t int, p int")
    r = score.score_class(df, "t", "p").first()
    assert r["accuracy"] == 0.5
    assert math.isclose(r["macro_f1"], (2 / 3 + 0.0) / 2)


def test_cluster_indices_on_blobs(spark):
    rows = []
    for b, (cx, cy) in enumerate([(0, 0), (10, 10), (20, 0)]):
        for i in range(20):
            rows.append((b * 100 + i, [cx + (i % 5) * 0.1, cy + (i // 5) * 0.1], b))
    df = spark.createDataFrame(rows, "id bigint, v array<double>, blob int")
    db = profile.davies_bouldin(df, "id", "v", "blob").first()[0]
    ch = profile.calinski_harabasz(df, "id", "v", "blob").first()[0]
    assert db < 0.1 and ch > 1000


def test_word_count_like_grep_wc(spark):
    df = spark.createDataFrame([("hello world\nab cd\n\tfoo  bar baz\n",)], "text string")
    assert profile.word_count(df, "text").first()["n_words"] == 5


def test_parse_answers_rejects(spark):
    from sparkfill.operators import prompt
    df = spark.createDataFrame([(1, '{"suggested_value": "1", "reasoning": "ok"}'), (2, '{"suggested_value": "0"}'),
                                (3, "not json")], "row_id bigint, output string")
    good, bad = prompt.split_answers(df)
    assert [r["row_id"] for r in good.collect()] == [1]
    assert sorted(r["row_id"] for r in bad.collect()) == [2, 3]


def test_generator_is_deterministic_and_bounded(spark):
    base = spark.range(0, 2000).withColumnRenamed("id", "row_id")
    a = synth.generate_table(base, "row_id")
    b = synth.generate_table(base.repartition(7), "row_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    st = a.agg(F.min("apgar_1"), F.max("apgar_1"), F.avg("mat_smoking"), F.corr("apgar_1", "apgar_2")).first()
    assert 0 <= st[0] and st[1] <= 10
    assert 0.15 < st[2] < 0.25 and st[3] > 0.5


def test_em_and_softimpute_fill_everything(spark):
    import random
    random.seed(3)
    rows = []
    for i in range(400):
        x = random.gauss(0, 1)
        y = 2 * x + random.gauss(0, 0.1)
        rows.append((i, x, None if i % 5 == 0 else y))
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double")
    for m in ("EM", "softimpute", "ice"):
        out = registry.impute_table(df, ["x", "y"], m, {"key": "row_id"})
        assert out.where(F.col("y").isNull()).count() == 0
        got = out.join(df.select("row_id", F.col("y").alias("y0")), "row_id")
        assert got.where(F.col("y0").isNotNull() & (F.abs(F.col("y") - F.col("y0")) > 1e-9)).count() == 0
    em = registry.impute_table(df, ["x", "y"], "EM").where(F.col("row_id") % 5 == 0)
    err = em.select(F.avg(F.abs(F.col("y") - 2 * F.col("x")))).first()[0]
    assert err < 0.2


def test_plans_have_no_cartesian_products(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for key in ["impute_nearest_code", "score_mae", "numeric_summary", "impute_by_cluster"]:
        plan = qs[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key


def test_fill_stream_applies_batch_constants(spark, tmp_path):
    from sparkfill.streaming import fill_stream
    from sparkfill.session import shared_path
    src = shared_path(spark, "stream_src")
    rows = [(1, 1.0), (2, None), (3, 3.0)]
    df = spark.createDataFrame(rows, "row_id bigint, a double")
    df.write.parquet(src)
    s = fill_stream(spark, df, src, ["a"])
    q = s.writeStream.format("memory").queryName("filled_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["row_id"], r["a"]) for r in spark.sql("SELECT * FROM filled_stream").collect())
    assert got == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_tree_attribution_sums_to_prediction(spark):
    import random
    from sparkfill.operators import stack
    from sparkfill.operators.attribution import tree_attribution
    random.seed(5)
    rows = [(i, random.random(), random.random(), 0.0) for i in range(500)]
    rows = [(i, a, b, 3 * a + (b > 0.5) + random.random() * 0.1) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, y double")
    m = stack.fit_stacker(df, ["a", "b"], "y", categorical=False)
    out = tree_attribution(m, df, df, ["a", "b"], "y", "row_id")
    bad = out.where(F.abs(F.col("base") + F.col("attr_a") + F.col("attr_b") - F.col("pred")) > 1e-9).count()
    assert out.count() == 500 and bad == 0


def test_detect_metadata_approx_agrees_on_small_table(spark):
    from sparkfill.sources import files
    df = spark.createDataFrame([(i, i % 3, f"s{i % 2}") for i in range(100)], "row_id bigint, a int, s string")
    ex = {r["column"]: (r["sdtype"], r["n_distinct"]) for r in files.detect_metadata(df, "row_id").collect()}
    ap = {r["column"]: (r["sdtype"], r["n_distinct"]) for r in files.detect_metadata(df, "row_id", exact=False).collect()}
    assert ex == {"row_id": ("id", 100), "a": ("categorical", 3), "s": ("categorical", 2)}
    assert {c: v[0] for c, v in ap.items()} == {c: v[0] for c, v in ex.items()}


def test_gower_knn_pruning_matches_brute_force(spark):
    import random
    random.seed(11)
    rows = [(i, random.random() * 10, random.choice(["a", "b", None]), float(random.randint(0, 1)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, c string, t double")
    qs = [r for r in rows if r[0] % 37 == 0]
    q = df.where(F.col("row_id") % 37 == 0)
    got = {r["row_id"]: (r["sum_near"], r["sum_far"]) for r in
           distance.gower_knn(df, q, "row_id", "t", ["x"], ["c"], k=10).collect()}
    for qr in qs:
        feats = [f for f, v in (("x", qr[1]), ("c", qr[2])) if v is not None]
        cands = [r for r in rows if r[3] is not None and all((r[1] if f == "x" else r[2]) is not None for f in feats)]
        xs = [r[1] for r in cands] + [qr[1]]
        rng = max(xs) - min(xs)
        def dist(r):
            terms = []
            if "x" in feats:
                terms.append(abs(r[1] - qr[1]) / rng if rng > 0 else 0.0)
            if "c" in feats:
                terms.append(0.0 if r[2] == qr[2] else 1.0)
            return sum(terms) / len(terms) if terms else 0.0
        near = sorted(cands, key=lambda r: (dist(r), r[0]))[:10]
        far = sorted(cands, key=lambda r: (-dist(r), r[0]))[:10]
        assert got[qr[0]] == (sum(r[3] for r in near), sum(r[3] for r in far))


def test_knn_fill_leaves_no_null_and_loses_no_row(spark, monkeypatch):
    import math

    from sparkfill.operators import distance
    monkeypatch.setattr(distance, "KNN_BLOCK", 30)  # several blocks a cluster
    rows = [(i, None if i % 11 == 0 else i % 3, float(i * 7 % 50) if i % 5 else None, float(i % 13), None if i % 4 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, cl int, a double, b double, y double")
    got = {r.row_id: r.y for r in distance.knn_fill(df, "row_id", "cl", "y", ["a", "b"], k=3).collect()}
    assert len(got) == 400 and all(v is not None for v in got.values())

    def dist(r, d):
        both = [(x, y) for x, y in zip(r[2:4], d[2:4]) if x is not None and y is not None]
        return math.sqrt(sum((x - y) ** 2 for x, y in both) * 2 / len(both))

    for r in rows:
        if r[4] is None:
            near = sorted((d for d in rows if d[1] == r[1] and d[4] is not None), key=lambda d: (dist(r, d), d[0]))[:3]
            assert abs(got[r[0]] - sum(d[4] for d in near) / 3) < 1e-9
    whole = distance.knn_fill(df, "row_id", None, "y", ["a", "b"], k=3)
    assert whole.where("y is null").count() == 0 and whole.count() == 400


def test_impute_by_cluster_keeps_rows_without_a_cluster(spark):
    from sparkfill.operators.impute import strategies
    rows = [(i, None if i % 10 == 0 else f"c{i % 3}", float(i % 7), None if i % 4 == 0 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, cl string, a double, y double")
    for size in (10, 10_000):
        out = strategies.impute_by_cluster(df, "row_id", "cl", "y", ["a"], "mean", min_size=size)
        assert out.count() == 1000 and out.where("y is null").count() == 0


def test_mask_random_hides_a_share_of_the_known_values(spark):
    from sparkfill.operators import sampling
    df = spark.createDataFrame([(i, None if i % 10 < 6 else float(i)) for i in range(1000)], "row_id long, y double")
    masked, hidden = sampling.mask_random(df, "y", "s")
    assert hidden.count() == 240 and masked.where("y is not null").count() == 160


def test_prompts_of_every_record_without_a_flag(spark, duck):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from sparkfill.plans.records import with_rec
    wanted = {r[0] for r in duck.execute(with_rec("SELECT row_id FROM rec WHERE flag IS NULL")).fetchall()}
    got = {r.row_id: r.dialogue for r in E.queries()["imputation_prompt"](spark, SF_SMALL).collect()}
    assert got.keys() == wanted and len(wanted) > 400
    assert all(d.count("\nseg: ") == 10 for d in got.values())  # ten neighbours in each


def test_scorer_reads_the_dialogue(spark):
    import json

    import pandas as pd
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from sparkfill.plans.q_insight import rule_scorer
    one = E.queries()["correction_prompt"](spark, SF_SMALL).first().dialogue
    few = re.sub(r"price: [\d.]+", "price: 1.00", re.sub(r"qty: [\d.]+", "qty: 1.00", one))
    none = re.sub(r"(price|qty|weight): [\d.]+", r"\1: 999999999.00", one)
    none = re.sub(r"nearest [\d.]+", "nearest 0.00", none)
    answers = [json.loads(a)["suggested_value"] for a in rule_scorer(pd.DataFrame({"dialogue": [few, none]}))]
    assert answers == ["1", "0"]
