"""Operator 8, document fingerprints: winnowing over word k-grams.

A text is cut into tokens (words; a letter of a script without spaces is one, and long words
are cut). Every run of ``k`` tokens has a hash, rolled up by doubling: the hash of 4 tokens
is that of two hashes of 2, and so on. Of each ``window`` consecutive hashes the least is
chosen, the rightmost of equal ones. So two texts that share ``window + k - 1`` tokens in a
row share a fingerprint, whatever lies around. Positions are kept with the hashes.

Everything is DataFrame functions: a hash (32 bits) and its position (31 bits, falling)
pack into one long, so the least of a window is a plain minimum, found by doubling too.

Defined results: a null or empty text has no tokens and an empty fingerprint; a text of
fewer tokens than ``k`` has the hash of all of them; two empty fingerprints are alike (1), an
empty one and another are not (0). Rows of equal id follow one another by text. A null
id comes first. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens a k-gram, and k-grams a window: any 20 tokens in a row that two texts share are found.
K, WINDOW = 5, 16
_POSITIONS = (1 << 31) - 1
#: A letter of a script written without spaces, or up to 16 characters of a word.
TOKEN = r"[⺀-鿿豈-﫿]|[^\x09-\x0D\x20⺀-鿿豈-﫿]{1,16}"
#: Documents that meet in a task to find each one's successor.
NEIGHBOURS = 4096


def _steps(n: int) -> list[int]:
    """Shifts that widen a span of 1 to ``n`` by doubling."""
    out, have = [], 1
    while have < n:
        out.append(min(have, n - have))
        have += out[-1]
    return out


def with_fingerprint(docs: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``out``: the chosen hashes of column ``text`` with their positions, packed, by position.

    Each step is a column of its own, so that nothing is evaluated twice.
    """
    h = "_hashes"
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    docs = docs.withColumn(h, F.transform(tokens, lambda t: F.xxhash64(t)))
    few = F.size(h) < k
    # a text of fewer tokens than k: one hash of all
    docs = docs.withColumn(h, F.when(few & (F.size(h) > 0), F.array(F.xxhash64(F.col(h)))).otherwise(F.col(h)))
    for step in _steps(k):
        n = F.size(h) - F.lit(step)
        rolled = F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, 1 + step, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        docs = docs.withColumn(h, F.when(n > 0, rolled).otherwise(F.col(h)))
    packed = F.transform(h, lambda v, i: F.shiftleft(v.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(_POSITIONS) - i).bitwiseAND(F.lit((1 << 63) - 1)))
    docs = docs.withColumn(h, packed)
    for step in _steps(window):
        n = F.size(h) - F.lit(step)
        least = F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, 1 + step, F.greatest(n, F.lit(0))), lambda a, b: F.least(a, b))
        docs = docs.withColumn(h, F.when(n > 0, least).otherwise(F.array_compact(F.array(F.array_min(h)))))
    return docs.withColumn(out, F.array_distinct(h)).drop(h)


def hashes(fingerprint: Column) -> Column:
    """The distinct 32-bit hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda p: F.shiftrightunsigned(p, 31)))


def as_text(fingerprint: Column) -> Column:
    """``position:hash`` of each chosen k-gram, joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda p: F.concat((F.lit(_POSITIONS) - p.bitwiseAND(F.lit(_POSITIONS))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(p, 31))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``doc_id, text, fingerprint``, an array of hash and position packed."""
    return with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fingerprint", k, window)


def with_next(docs: DataFrame, order: str, carried: list[str], group: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``next_<c>`` of the row that follows in ``order`` (after the last, the first).

    Rows meet in ranges of about ``group`` ids. The ranges' bounds are quantiles of the ids,
    each range cut evenly into more for large tables, so one far id does not upset them.
    The first rows of a range also go to the range before, as what follows its last.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("k"))
    stats = ids.agg(F.count("k").alias("n")).first()
    ranges = max(1, -(-stats.n // group))
    coarse = min(ranges, 256)
    cuts = ids.agg(F.percentile_approx("k", [i / coarse for i in range(coarse + 1)], 100 * coarse).alias("q")).first().q if stats.n else []
    cuts = sorted(set(cuts or [])) or [0]
    fine = -(-ranges // coarse)
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("_key"))), F.lit(1))
    low, high = F.element_at(bounds, at), F.element_at(bounds, F.least(at + 1, F.lit(len(cuts))))
    # the share of the way from one bound to the next, in floating point: bounds may lie far apart
    share = (F.col("_key").cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    part = at.cast("long") * fine + F.least(F.greatest(F.floor(share * fine), F.lit(0)), F.lit(fine - 1)).cast("long")
    rows = docs.withColumn("_key", key).withColumn("_part", part)
    # the least id of each range, and the range before it that has rows
    first = rows.groupBy("_part").agg(F.min("_key").alias("_key"))
    chain = Window.orderBy("_part")  # one short row a range
    before = first.select(F.col("_part").alias("p"), F.col("_key").alias("k"), F.lag("_part").over(chain).alias("before"))
    last = first.agg(F.max("_part").alias("before_first"))
    before = before.crossJoin(F.broadcast(last)).select("p", "k", F.coalesce("before", "before_first").alias("before"))
    rows = rows.join(F.broadcast(before), (F.col("_part") == F.col("p")) & (F.col("_key") == F.col("k")), "left")
    place = lambda part, ghost: F.struct(part.alias("part"), F.lit(ghost).alias("ghost"))
    # a range's first row also goes to the range before, where it sorts last: ghost 1
    to = F.array_compact(F.array(place(F.col("_part"), 0), F.when(F.col("p").isNotNull(), place(F.col("before"), 1))))
    rows = rows.select(*docs.columns, "_key", F.explode(to).alias("_to")).select(*docs.columns, "_key", F.col("_to.part").alias("_part"), F.col("_to.ghost").alias("_ghost"))
    line = Window.partitionBy("_part").orderBy("_ghost", "_key", *carried[:1])
    out = rows.select(*docs.columns, "_ghost", *(F.lead(c).over(line).alias(f"next_{c}") for c in carried))
    return out.where("_ghost = 0").drop("_ghost")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, and the text whose second half the next document's beginning replaces.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_fingerprint(own, "text", "fingerprint", k, window)
    pairs = with_next(own, "doc_id", ["text", "fingerprint"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = with_fingerprint(pairs.withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_fingerprint", k, window)
    pairs = pairs.withColumn("own", hashes(F.col("fingerprint")))
    return pairs.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), hashes(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_fingerprint"))).alias("near_next"),
    )
