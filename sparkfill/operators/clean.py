"""Projections, filters and cleaning (B1-B19). All plain column expressions or joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.ordered import dense_codes
from sparkfill.functions.scalars import NUMERIC_TYPES
from sparkfill.session import broadcast_checked


def sentinel_to_null(df: DataFrame, sentinels: Mapping[str, Sequence], case_insensitive: bool = True) -> DataFrame:
    """Replace coded 'unknown' values with null, per column (B1)."""
    types = dict(df.dtypes)
    exprs = {}
    for c, vals in sentinels.items():
        if types[c] in NUMERIC_TYPES:
            hit = F.col(c).isin([float(v) for v in vals])
        elif case_insensitive:
            hit = F.lower(F.col(c)).isin([str(v).lower() for v in vals])
        else:
            hit = F.col(c).isin(list(vals))
        exprs[c] = F.when(hit, F.lit(None).cast(types[c])).otherwise(F.col(c))
    return df.withColumns(exprs)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return rename_columns(df, {c: c[len(prefix):] for c in df.columns if c.startswith(prefix)})


def drop_by_rule(df: DataFrame, keep: Callable[[str], bool], also_drop: Sequence[str] = ()) -> DataFrame:
    """Keep columns for which ``keep(name)`` holds, minus ``also_drop``."""
    drop = set(also_drop)
    return df.select(*[c for c in df.columns if keep(c) and c not in drop])


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def unit_scale(df: DataFrame, column: str, factor: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, F.col(column).cast("double") * F.lit(factor))


def range_filter(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """AND of inclusive ranges; a null fails its range."""
    cond = F.lit(True)
    for c, (lo, hi) in ranges.items():
        cond = cond & F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    return df.where(cond)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def fill_constant(df: DataFrame, value=-1, subset: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with a constant (MNAR mode, B8)."""
    types = dict(df.dtypes)
    cols = [c for c in (subset or df.columns) if types[c] in NUMERIC_TYPES]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(types[c])) for c in cols})


def null_mask(df: DataFrame, cols: Sequence[str], out: str = "null_mask") -> DataFrame:
    """Pack the null pattern of ``cols`` into one bigint (bit i = cols[i] is null)."""
    m = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        m = m + F.shiftleft(F.col(c).isNull().cast("bigint"), i)
    return df.withColumn(out, m)


def missing_indicators(df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "_missing") -> DataFrame:
    """Add ``<col>_missing`` 0/1 per column."""
    cols = list(cols or df.columns)
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols})


def usable_columns_by_group(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(group, column, n_present, usable): columns with no value inside a group are unusable."""
    agg = df.groupBy(group).agg(*[F.count(c).alias(c) for c in cols])
    lv = agg.unpivot([group], list(cols), "column", "n_present")
    return lv.withColumn("usable", (F.col("n_present") > 0).cast("int"))


def missing_ratios(df: DataFrame, cols: Sequence[str] | None = None) -> dict:
    """Share of nulls per column in one aggregate."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return row.asDict()


def keep_dense_columns(df: DataFrame, cols: Sequence[str] | None = None, max_ratio: float = 0.10,
                       always: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose missing ratio is at most ``max_ratio``."""
    ratios = missing_ratios(df, cols)
    keep = [c for c in df.columns if c in always or (c in ratios and ratios[c] <= max_ratio)]
    return df.select(*keep)


def round_frame(df: DataFrame, digits: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Half-even rounding of numeric columns (B13, pandas ``round``)."""
    types = dict(df.dtypes)
    cols = [c for c in (cols or df.columns) if types[c] in NUMERIC_TYPES]
    return df.withColumns({c: F.bround(F.col(c), digits) for c in cols})


def round_to_code(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nearest integer (half-even) as int, for categorical columns."""
    return df.withColumns({c: F.rint(F.col(c)).cast("int") for c in cols})


def case_bins(x, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed ordered bands: x <= edges[0] -> labels[0] ... else labels[-1]; null stays null."""
    xc = F.col(x) if isinstance(x, str) else x
    expr = None
    for e, lab in zip(edges, labels):
        expr = (F.when(xc <= e, F.lit(lab)) if expr is None else expr.when(xc <= e, F.lit(lab)))
    expr = expr.when(xc.isNotNull(), F.lit(labels[len(edges)]))
    return expr


def map_labels(x, mapping: Mapping) -> Column:
    """Code/name -> display label through a literal map; unmapped -> null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), F.col(x) if isinstance(x, str) else x)


def label_by_substring(x, rules: Sequence[tuple], default=None) -> Column:
    """First rule whose substring occurs in the value gives the label."""
    xc = F.col(x) if isinstance(x, str) else x
    expr = None
    for sub, lab in rules:
        expr = F.when(xc.contains(sub), F.lit(lab)) if expr is None else expr.when(xc.contains(sub), F.lit(lab))
    return expr.otherwise(F.lit(default))


def decode_codes(df: DataFrame, column: str, dim: DataFrame, code_col: str = "code",
                 label_col: str = "category", out: str | None = None) -> DataFrame:
    """Code -> category through a dimension table; unmapped codes give null."""
    d = dim.select(F.col(code_col).alias("__code"), F.col(label_col).alias(out or f"{column}_label"))
    return df.join(broadcast_checked(d), F.col(column) == F.col("__code"), "left").drop("__code")


def in_list_filter(df: DataFrame, block: str, code: str, block_codes: DataFrame) -> DataFrame:
    """Rows whose code is in the list of codes of the row's block (B18): a semi join.

    ``block_codes`` is long (block, code)."""
    return df.join(block_codes.select(block, code).distinct(), [block, code], "left_semi")


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Alphabetical 0-based codes per column (B19, pandas ``cat.codes``); null -> -1."""
    out = df
    for c in cols:
        codes = dense_codes(df, [], c, out=f"{c}{suffix}")
        out = (out.join(broadcast_checked(codes), c, "left")
                  .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(-1))))
    return out
