"""Text templates that render both as a Spark column and as DuckDB SQL.

A template is a sequence of parts; each part is literal text or a value. Null
values render as 'None' in both engines, so the Spark output and its SQL oracle
produce identical strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Part:
    kind: str            # lit | str | fmt2 | raw
    text: str = ""       # literal text, or column name
    spark: object = None  # raw part: a column name or a zero-argument function returning a Column
    sql: str | None = None

    def to_spark(self) -> Column:
        if self.kind == "lit":
            return F.lit(self.text)
        if self.kind == "str":
            return F.coalesce(F.col(self.text).cast("string"), F.lit("None"))
        if self.kind == "fmt2":
            x = F.col(self.text).cast("double")
            # Java's %.2f prints a null argument as "nu", so test for null first
            return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise(F.lit("None"))
        c = F.col(self.spark) if isinstance(self.spark, str) else self.spark()
        return F.coalesce(c, F.lit("None"))

    def to_sql(self, prefix: str = "") -> str:
        if self.kind == "lit":
            return _sql_str(self.text)
        if self.kind == "str":
            return f"coalesce(cast({prefix}{self.text} AS varchar), 'None')"
        if self.kind == "fmt2":
            return f"coalesce({sql_fmt2(prefix + self.text)}, 'None')"
        return f"coalesce({self.sql}, 'None')"


def sql_fmt2(x: str) -> str:
    """DuckDB spelling of Spark's format_string('%.2f', x): Java rounds half-up on the
    shortest decimal representation of the double, so do the same through a decimal."""
    return f"printf('%.2f', round(cast(cast(cast({x} AS double) AS varchar) AS DECIMAL(38, 10)), 2))"


def lit(text: str) -> Part:
    return Part("lit", text)


def val(name: str) -> Part:
    return Part("str", name)


def num(name: str) -> Part:
    return Part("fmt2", name)


def raw(spark, sql: str) -> Part:
    """A pre-built value: ``spark`` is a column name or a function returning a Column
    (built lazily, so templates can be declared before a session exists)."""
    return Part("raw", spark=spark, sql=sql)


class Template:
    def __init__(self, *parts: Part):
        self.parts = list(parts)

    def __add__(self, other: Template) -> Template:
        return Template(*(self.parts + other.parts))

    def spark(self) -> Column:
        return F.concat(*[p.to_spark() for p in self.parts]) if self.parts else F.lit("")

    def sql(self, prefix: str = "") -> str:
        return "(" + " || ".join(p.to_sql(prefix) for p in self.parts) + ")" if self.parts else "''"


def record_text(cols: list[str], numeric: set[str] | None = None) -> Template:
    """'name: value, name: value, ...' for a record (numbers with two decimals)."""
    parts: list[Part] = []
    for i, c in enumerate(cols):
        parts.append(lit(("" if i == 0 else ", ") + f"{c}: "))
        parts.append(num(c) if numeric and c in numeric else val(c))
    return Template(*parts)
