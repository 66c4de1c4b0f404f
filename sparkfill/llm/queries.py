"""The registered queries of the operators in this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfill.llm import centroids, codes, decontaminate, fingerprint, jaccard, packing, quality, secrets, substring, tokens, toxicity, urls, wavelet
from sparkfill.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(read_table(spark, sf_dir, "documents"), budgets=(1024,), with_prefixes=True)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_1024", "prefix_counts")


@query("op2_decontamination", """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM bp),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.p, d.n, win.item_id
         FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp) d JOIN win ON d.n = win.n AND d.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("longest")


#: Hosts of the list behind op5: fixed values, the words of unwanted hosts among the pages.
LISTED_HOSTS = r"(^|\.)(casino-win|cheap-pills|free-bets|ads-track)\."


@query("op5_url_filter", f"""
WITH parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q
  FROM pages),
own AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS u,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
listed AS (SELECT DISTINCT u FROM own WHERE regexp_matches(host, '{LISTED_HOSTS}') AND u IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed.u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  listed.u IS NOT NULL AS listed
FROM own LEFT JOIN listed ON own.u = listed.u
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(urls.canonical(F.col("url")).alias("url"))
    return urls.judge_urls(pages, listed)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query("op3_ngram_jaccard", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS copy FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
  UNION ALL
  SELECT x.doc_id, y.doc_id, true FROM words x, words y WHERE len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS class_id,
       (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links, (SELECT count(*) FROM links WHERE a = d.doc_id AND copy) AS n_copies
FROM documents d
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words WHERE len(w) >= 35)),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS pos FROM wins WHERE h IN (SELECT h FROM twice)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read_table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op11_centroid_clustering", """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT rid, unnest(q) AS y, unnest(range(1, 65)) AS pos FROM kept),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, q) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),
c0 AS (SELECT c, pos, y FROM seeds JOIN v USING (rid)),
a0 AS (SELECT rid, c AS cluster, d FROM (SELECT v.rid, c0.c, sum((v.y - c0.y) * (v.y - c0.y))::BIGINT AS d FROM v JOIN c0 USING (pos) GROUP BY v.rid, c0.c)
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
m0 AS (SELECT cluster AS c, pos, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a0 JOIN v USING (rid) GROUP BY cluster, pos),
c1 AS (SELECT c, pos, coalesce(m0.y, c0.y)::BIGINT AS y FROM c0 LEFT JOIN m0 USING (c, pos)),
a1 AS (SELECT rid, c AS cluster, d FROM (SELECT v.rid, c1.c, sum((v.y - c1.y) * (v.y - c1.y))::BIGINT AS d FROM v JOIN c1 USING (pos) GROUP BY v.rid, c1.c)
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
m1 AS (SELECT cluster AS c, pos, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a1 JOIN v USING (rid) GROUP BY cluster, pos),
c2 AS (SELECT c, pos, coalesce(m1.y, c1.y)::BIGINT AS y FROM c1 LEFT JOIN m1 USING (c, pos)),
a2 AS (SELECT rid, c AS cluster, d FROM (SELECT v.rid, c2.c, sum((v.y - c2.y) * (v.y - c2.y))::BIGINT AS d FROM v JOIN c2 USING (pos) GROUP BY v.rid, c2.c)
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
m2 AS (SELECT cluster AS c, pos, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a2 JOIN v USING (rid) GROUP BY cluster, pos),
c3 AS (SELECT c, pos, coalesce(m2.y, c2.y)::BIGINT AS y FROM c2 LEFT JOIN m2 USING (c, pos)),
a3 AS (SELECT rid, c AS cluster, d FROM (SELECT v.rid, c3.c, sum((v.y - c3.y) * (v.y - c3.y))::BIGINT AS d FROM v JOIN c3 USING (pos) GROUP BY v.rid, c3.c)
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
of_cluster AS (SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster),
sha AS (SELECT c AS cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, cluster::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a3) AS inertia, centroid_sha256
FROM a3 JOIN kept USING (rid) JOIN of_cluster USING (cluster) JOIN sha USING (cluster)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(read_table(spark, sf_dir, "embeddings"))


@query("op12_vector_codes", """
WITH kept AS (
  SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT len(any_value(q)) // 16 AS w FROM kept),
v AS (SELECT rid, unnest(q) AS y, unnest(range(0, len(q))) // w AS part, unnest(range(0, len(q))) % w AS pos FROM kept, w),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM kept WHERE vec_id IS NOT NULL QUALIFY e < 64),
b0 AS (SELECT part, e, pos, y FROM seeds JOIN v USING (rid)),
a0 AS (SELECT rid, part, e, d FROM (SELECT v.rid, part, b.e, sum((v.y - b.y) * (v.y - b.y))::BIGINT AS d FROM v JOIN b0 b USING (part, pos) GROUP BY v.rid, part, b.e)
       QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, e) = 1),
m0 AS (SELECT part, e, pos, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a0 JOIN v USING (rid, part) GROUP BY part, e, pos),
b1 AS (SELECT part, e, pos, coalesce(m.y, b.y)::BIGINT AS y FROM b0 b LEFT JOIN m0 m USING (part, e, pos)),
a1 AS (SELECT rid, part, e, d FROM (SELECT v.rid, part, b.e, sum((v.y - b.y) * (v.y - b.y))::BIGINT AS d FROM v JOIN b1 b USING (part, pos) GROUP BY v.rid, part, b.e)
       QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, e) = 1),
m1 AS (SELECT part, e, pos, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a1 JOIN v USING (rid, part) GROUP BY part, e, pos),
b2 AS (SELECT part, e, pos, coalesce(m.y, b.y)::BIGINT AS y FROM b1 b LEFT JOIN m1 m USING (part, e, pos)),
a2 AS (SELECT rid, part, e, d FROM (SELECT v.rid, part, b.e, sum((v.y - b.y) * (v.y - b.y))::BIGINT AS d FROM v JOIN b2 b USING (part, pos) GROUP BY v.rid, part, b.e)
       QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, e) = 1),
coded AS (SELECT rid, string_agg(format('{:02x}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM b2),
of_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (rid) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) JOIN of_label ON kept.label IS NOT DISTINCT FROM of_label.label, books
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(read_table(spark, sf_dir, "embeddings"))


@query("op13_wavelet_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(spark, wavelet.write_tokens(read_table(spark, sf_dir, "documents")))
