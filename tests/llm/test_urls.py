from pyspark.sql import functions as F
from sparkfill.llm import urls

URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.Example.ORG/es/x?q#f", "http://example.org/en/1", "http://example.org/en/2",
        "http://notexample.org/es/1", "http://x.com/de/1", "http://x.com/fr", "http://x.com/fr/", "x://y://z/de/", "http://net/listed/?utm_a=1&b=2&a=1#t", "http://www.net/listed?a=1&b=2",
        "http://net/listed", "http://É.com/de/\n2", "http://a.com?x=/de/", "HTTP://com/de/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = max((r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.name), default=None)
    return host, path, best


def test_rules_and_list(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (1, URLS[14]), (None, URLS[14])], "page_id long, url string").withColumns({"rule": F.lit(1), "u": F.lit("x"), "block": F.lit(2)})
    listed = spark.createDataFrame([("net/listed?a=1&b=2",), ("net/listed?a=1&b=2",), (None,), ("elsewhere",), ("x.com/fr",)], "url string")
    rows = urls.judge_urls(pages, listed).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is None or (r.page_id == 1 and r.host):
            assert (r.verdict, r.rule, r.listed) == ("block", None, True)
            continue
        host, path, best = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == (best.verdict if best else "block" if r.page_id in (11, 14, 15) else "allow")
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0)).collect() if r.rule is None} == {"allow"}
    assert urls.judge_urls(pages.limit(0), listed).count() == 0


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(2000).select(F.concat(F.lit("host/"), "id").alias("url"))
    words, blocks = urls.blocked_bloom(listed)
    asked = spark.range(4000).select(F.concat(F.lit("host/"), "id").alias("u"), "id")
    passed = asked.withColumn("block", urls._block(F.col("u"), blocks)).join(words, "block")
    for k, b in enumerate(urls._bits(F.col("u"))):
        passed = passed.where(F.col(f"w{k}").bitwiseAND(b) != 0)
    ids = [r.id for r in passed.collect()]
    assert sum(i < 2000 for i in ids) == 2000 and sum(i >= 2000 for i in ids) < 60
    assert urls.in_list(asked.withColumnRenamed("u", "url"), listed).count() == 2000
