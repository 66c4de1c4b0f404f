"""Prompt tables, request objects, scoring hook and answer parsing.

Prompts are array<struct<role, content>> columns built for every record at once;
the scoring hook runs a caller-supplied batch function in ``mapInPandas`` (Arrow
batches, one call per batch); answers are parsed with ``from_json``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.functions.template import Template, lit, num, raw, val

ANSWER_SCHEMA = "suggested_value string, reasoning string"


def messages(turns: Sequence[tuple[str, Template]]) -> Column:
    """array<struct<role, content>> from (role, template) turns."""
    return F.array(*[F.struct(F.lit(r).alias("role"), t.spark().alias("content")) for r, t in turns])


def dialogue_text(msgs: Column) -> Column:
    """One string for a dialogue: 'role: content' blocks separated by blank lines."""
    return F.array_join(F.transform(msgs, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


def dialogue_sql(turns: Sequence[tuple[str, Template]], prefix: str = "") -> str:
    blocks = [f"('{r}: ' || {t.sql(prefix)})" for r, t in turns]
    return "(" + " || chr(10) || chr(10) || ".join(blocks) + ")"


def answer_format() -> str:
    return ('Reply with a JSON object only: {"suggested_value": "0 or 1", '
            '"reasoning": "a short argument that uses the record\'s own values"}.')


def imputation_turns(target: str, record: Template, dictionary: str, selected: Sequence[str]) -> list:
    """The seven-question imputation dialogue (K4); needs columns insights, sum_near, sum_far and
    neighbours (the nearest records as text, one a line)."""
    return [
        ("user", Template(lit(f"We need a value for the missing field {target} of one record. Work from the "
                              "statistics and the neighbouring records given below, and reason step by step."))),
        ("assistant", Template(lit("Understood. Please share the record with the missing value."))),
        ("user", Template(lit("Record (the reference point for every conclusion): ")) + record),
        ("assistant", Template(lit("What do the fields of the record mean?"))),
        ("user", Template(lit("Field meanings: " + dictionary))),
        ("assistant", Template(lit(f"Which fields are most related to {target}?"))),
        ("user", Template(lit("Selected fields: " + ", ".join(selected)))),
        ("assistant", Template(lit(f"How are these fields distributed with respect to {target}?"))),
        ("user", Template(lit("Statistics over the whole table, at this record's values:\n"),
                          raw("insights", "insights"))),
        ("assistant", Template(lit("Which records are closest to this one?"))),
        ("user", Template(lit(f"Over the 10 nearest records {target} sums to "), num("sum_near"),
                          lit("; over the 10 farthest it sums to "), num("sum_far"),
                          lit(". The nearest, closest first:\n"), raw("neighbours", "neighbours"))),
        ("assistant", Template(lit("Is there guidance for the final decision?"))),
        ("user", Template(lit("Look at the record's values, relate them to the statistics, compare the neighbours, "
                              "and keep the argument short. " + answer_format()))),
    ]


def correction_turns(target: str, record: Template, dictionary: str, rules: Sequence[str]) -> list:
    """Dialogue for a two-against-one vote (K5); needs columns minority, majority and
    near_<scope>/far_<scope> for scopes full, selected, cluster."""
    scope_parts = []
    for s in ("full", "selected", "cluster"):
        scope_parts += [lit(f"{s}: nearest "), num(f"near_{s}"), lit(", farthest "), num(f"far_{s}"), lit(". ")]
    return [
        ("user", Template(lit(f"Three fill strategies disagree on {target} for one record. Act as the tie-breaker."))),
        ("assistant", Template(lit("Please share the record."))),
        ("user", record),
        ("assistant", Template(lit("What do the fields mean?"))),
        ("user", Template(lit("Field meanings: " + dictionary))),
        ("assistant", Template(lit("What did the strategies propose?"))),
        ("user", Template(lit("Two strategies propose "), val("majority"), lit(" and one proposes "), val("minority"),
                          lit(". Decide whether the single proposal "), val("minority"), lit(" is right."))),
        ("assistant", Template(lit("Which indicators should I check?"))),
        ("user", Template(lit("Indicators: " + "; ".join(rules) + f". Neighbour counts of {target} = 1 per scope: "),
                          *scope_parts,
                          lit("Count an indicator for 1 when the nearest exceed the farthest in at least two scopes. "
                              "Answer 1 when at least two indicators hold, else 0. " + answer_format()))),
    ]


def rationale_prompt(target: str, record: Template) -> Template:
    """Single prompt giving the known value and asking for the reasoning (K8); needs columns
    target_value and insights (text, may be null)."""
    return Template(lit(f"The record below has {target} = "), val("target_value"),
                    lit(". Explain, from the record and the statistics, why this value is plausible.\nRecord: ")) \
        + record + Template(lit("\nStatistics: "), raw(lambda: F.when(F.length("insights") > 0, F.col("insights")),
                                                         "CASE WHEN length(insights) > 0 THEN insights END"))


def request_struct(custom_id: Column, prompt: Column, model: str, url: str = "/v1/chat/completions",
                   system: str = "You explain values in tabular records.", max_tokens: int = 800) -> Column:
    """Batch request object per row (K9)."""
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                            F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
                    F.lit(max_tokens).alias("max_tokens"))
    return F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"),
                    body.alias("body"))


def score_prompts(df: DataFrame, scorer: Callable, input_cols: Sequence[str], keep: Sequence[str],
                  out: str = "output") -> DataFrame:
    """Apply ``scorer(pandas.DataFrame) -> sequence of str`` to Arrow batches.

    The scorer is the caller's (a model client, or a rule); Spark only ships batches."""
    cols = list(dict.fromkeys(list(keep) + list(input_cols)))
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*keep).dtypes] + [f"`{out}` string"])

    def run(batches):
        for pdf in batches:
            res = pdf[list(keep)].copy()
            res[out] = list(scorer(pdf))
            yield res

    return df.select(*cols).mapInPandas(run, schema)


def parse_answers(df: DataFrame, text_col: str = "output") -> DataFrame:
    """Parse answers; ``valid`` requires both fields (K11). Malformed text parses to nulls."""
    p = df.withColumn("__a", F.from_json(F.col(text_col), ANSWER_SCHEMA, {"mode": "PERMISSIVE"}))
    return p.select("*", F.col("__a.suggested_value").alias("value"), F.col("__a.reasoning").alias("reasoning"),
                    (F.col("__a.suggested_value").isNotNull() & F.col("__a.reasoning").isNotNull()).alias("valid")) \
        .drop("__a")


def split_answers(df: DataFrame, text_col: str = "output") -> tuple[DataFrame, DataFrame]:
    p = parse_answers(df, text_col)
    return p.where(F.col("valid")), p.where(~F.col("valid"))
