"""Operator 6, secret scans: a trigram index picks candidates, the regular expressions verify them.

Each rule's expression gives a Boolean query over trigrams that any match must hold, derived from
its parse tree (``trigrams.py``): any of some lists, each with all its trigrams. The inverted index
holds, for each trigram that some rule asks for, the documents whose lower-cased text has
it. Intersecting the postings of a list and uniting those of the lists leaves the
rule's candidates, and only they are matched. A rule without a mandatory trigram, such as a run
of hexadecimal digits, scans every document.

Everything is DataFrame functions. Positions come from cutting a text at the same matches
that are extracted: what lies between them adds up to where each begins, in code points. The sums
of the first 1, 2, 4, 8, ... lengths before each give them in ``n log n`` steps for ``n`` matches, so a
very long text of many matches is no quadratic work.

Defined results: a null or empty text has no spans; a text of any length is searched whole; matches of
two rules at one place are both spans, in the order of the rules; rows of one id and text share a posting
and each get the spans; a null id stays null; an empty table gives an empty table. Other
columns of the input are neither read nor returned by ``find_secrets``; ``redact`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.llm import trigrams
from sparkfill.llm.text import text_key


@dataclass(frozen=True)
class Rule:
    """``group`` of the match has ``least`` characters or more; shorter matches are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Fixed values of the contract. Runs are cut to their least length where that drops the same matches.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the index makes cheap to look for besides: rules with rare mandatory trigrams.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


#: Trigrams of one number of the bit mask.
MASK_BITS = 63


def trigram_query(rule: Rule) -> list[list[str]]:
    """Any of these lists has all its trigrams in a match; empty if no trigram is mandatory."""
    return trigrams.trigram_query(rule.regex)


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def inverted_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``trigram, doc_id, text_key`` of the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for q in trigram_query(r) for t in q})
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), "doc_id", text_key(F.col("text")).alias("text_key")).limit(0)
    held = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("folded"), t))
    folded = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _folded(F.col("text")).alias("folded"))
    return folded.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text_key, may``: the kinds of the rules with a trigram query that a text meets.

    Postings are intersected by document: a set of wanted trigrams is a bit mask, in as many
    numbers as the rules need, which are united with partial aggregation, so a document's
    postings meet as a few numbers.
    """
    indexed = [r for r in rules if trigram_query(r)]
    wanted = sorted({t for r in indexed for q in trigram_query(r) for t in q})
    parts = [wanted[i : i + MASK_BITS] for i in range(0, len(wanted), MASK_BITS)]

    def bits(part: list[str]) -> Column:
        of = F
        for i, t in enumerate(part):
            of = of.when(F.col("trigram") == t, F.lit(1 << i).cast("long"))
        return F.bit_or(of.otherwise(F.lit(0).cast("long")))

    if not parts:
        return postings.select("doc_id", "text_key", F.expr("cast(array() as array<string>)").alias("may")).limit(0)
    held = postings.groupBy("doc_id", "text_key").agg(*(bits(part).alias(f"held_{n}") for n, part in enumerate(parts)))

    def has(q: list[str]) -> Column:
        out = F.lit(True)
        for n, part in enumerate(parts):
            need = F.lit(sum(1 << i for i, t in enumerate(part) if t in q)).cast("long")
            out = out & (F.col(f"held_{n}").bitwiseAND(need) == need)
        return out

    def may(rule: Rule) -> Column:
        out = F.lit(False)
        for q in trigram_query(rule):
            out = out | has(q)
        return out

    # one column for all rules: with one for each, the optimizer derives conditions for all sets of rules
    kinds = F.filter(F.array(*(F.when(may(r), F.lit(r.kind)) for r in indexed)), lambda k: k.isNotNull())
    return held.select("doc_id", "text_key", kinds.alias("may")).where(F.size("may") > 0)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans ``start, rank, stop, kind`` of a rule's matches, by code points."""
    whole, between = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    parts = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(whole.alias("m"), F.slice(between, 1, F.size(whole)).alias("b"), parts.alias("g"))
    kind = F.lit(rule.kind)
    # ``stop``: first the length from the match before to this one's end, then sums of 2, 4, 8, ... of them
    lengths = F.transform(rows, lambda r: F.struct(
        (F.char_length(r["b"]) + F.char_length(r["m"])).alias("stop"), F.char_length(r["m"]).alias("own"), F.char_length(r["g"]).alias("part")))
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(whole) + F.lit(1))).cast("int"))

    def add(acc: Column, step: Column) -> Column:
        far = F.pow(F.lit(2), step).cast("int")
        nothing = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("own"), F.lit(0).alias("part"))
        before = F.slice(F.concat(F.array_repeat(nothing, far), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, before, lambda x, y: F.struct((x["stop"] + y["stop"]).alias("stop"), x["own"].alias("own"), x["part"].alias("part")))

    def spans(acc: Column) -> Column:
        kept = F.filter(acc, lambda r: r["part"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(
            (r["stop"] - r["own"]).alias("start"), F.lit(rank).alias("rank"), r["stop"].alias("stop"), kind.alias("kind")))

    return F.aggregate(doublings, lengths, add, spans)


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``docs``, which has ``doc_id, text``, with ``spans`` of all rules in order."""
    none = F.expr("cast(array() as array<struct<start: int, rank: int, stop: int, kind: string>>)")
    flags = candidates(inverted_index(docs, rules), rules).withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (text_key(F.col("text")) == F.col("c_key"))
    out = docs.join(flags, same, "left")
    found = []
    for rank, rule in enumerate(rules):
        may = F.coalesce(F.array_contains("may", rule.kind), F.lit(False)) if trigram_query(rule) else F.lit(True)
        # most candidates have no match: a test that stops at the first is cheaper than the spans
        found.append(F.when(may & F.col("text").rlike(rule.regex), _matches(F.col("text"), rule, rank)).otherwise(none))
    return out.withColumn("spans", F.array_sort(F.flatten(F.array(*found)))).drop("c_id", "c_key", "may")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``doc_id, spans``: an array of ``start, rank, stop, kind`` in code points, stop exclusive."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(own, rules).select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts and check sums of :func:`find_secrets` a document."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
           by: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``by``, overlapping spans together; all columns stay.

    ``length_col`` names a column that holds the text's number of characters, to be kept right.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(by))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length(F.col("text"))))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", zero, add, rest)).otherwise(F.col("text"))
    out = _with_spans(whole, rules).withColumn("clean", clean)
    cols = []
    for c in docs.columns:
        old = F.col("row")[c]
        new = F.col("clean") if c == text_col else F.when(F.size("spans") > 0, F.char_length("clean").cast(docs.schema[c].dataType)).otherwise(old) if c == length_col else old
        cols.append(new.alias(c))
    return out.select(*cols)
