"""Operator 5, URL filters: path rules first, else a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: a block number and four 64-bit words. A listed URL sets one bit in
each word of the one block it falls in, so building is one grouped ``bit_or`` and probing
is one lookup. It has few false positives and no false negatives, so only URLs that it
passes go on to the exact hash join with the list, which removes the false ones. The
filter's size follows the list (``BITS`` bits an entry); it is broadcast only if that is
proven to be small, else joined on the block number.

Everything is DataFrame functions. Defined results: a null URL, or one without ``://``, has
an empty host and path, fits no rule, and is in no list; repeated rows give repeated
results; an empty list blocks nothing; an empty table gives an empty table. Other columns
of the input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL; about 1 in 400 others passes.
BITS = 16
#: Bytes of the largest filter that is broadcast.
BROADCAST_BYTES = 16_000_000
_BLOCK_BITS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and for paths that start alike."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``, ``utm_`` parameters, fragment and trailing slash; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """One of 64 bits for each of the four words of a block."""
    h = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def blocked_bloom(listed: DataFrame, url_col: str = "url", bits: int = BITS) -> tuple[DataFrame, int]:
    """The filter of the canonical URLs in ``url_col`` as a table ``block, w0..w3``, and its number of blocks."""
    urls = listed.select(F.col(url_col).alias("u")).where("u is not null")
    n = urls.agg(F.approx_count_distinct("u")).first()[0]
    blocks = max(1, -(-n * bits // _BLOCK_BITS))
    words = [F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits(F.col("u")))]
    return urls.groupBy(_block(F.col("u"), blocks).alias("block")).agg(*words), blocks


def in_list(urls: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """The distinct canonical URLs of ``urls`` that are listed: ``u``."""
    words, blocks = blocked_bloom(listed, listed_col)
    if blocks * 40 <= BROADCAST_BYTES:
        words = F.broadcast(words)
    wanted = urls.select(F.col(url_col).alias("u")).where("u is not null").distinct()  # a hot URL is asked once
    possible = wanted.withColumn("block", _block(F.col("u"), blocks)).join(words, "block")
    for k, b in enumerate(_bits(F.col("u"))):
        possible = possible.where(F.col(f"w{k}").bitwiseAND(b) != 0)
    exact = listed.select(F.col(listed_col).alias("u")).where("u is not null").distinct()
    return possible.select("u").join(exact.hint("shuffle_hash"), "u", "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url",
               listed_col: str = "url") -> DataFrame:
    """Returns ``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``listed`` holds canonical URLs (see :func:`canonical`). A rule's verdict holds; without
    a fitting rule a listed URL is blocked and any other allowed.
    """
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("u"))
    own = own.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    hits = in_list(own, listed, "u", listed_col).withColumn("listed", F.lit(True))
    out = own.join(hits, "u", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")
