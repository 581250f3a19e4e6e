"""Quality gates around a provider's answers, and recovery of the JSON in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import n_tokens, strip

END = "</analysis>"


def length_gate(source: Column, output: Column, low: float = 0.3, high: float = 2.0) -> Column:
    """'short', 'long', 'ok', or 'skipped' without source tokens; the bounds themselves are fine."""
    ratio = F.try_divide(n_tokens(output), n_tokens(source))
    return F.when(n_tokens(source) == 0, "skipped").when(ratio < low, "short").when(ratio > high, "long").otherwise("ok")


def analysis(answer: Column) -> Column:
    """struct<has_boundary, analysis, text>: what is up to and after the last end mark."""
    has = answer.contains(END)
    return F.struct(has.alias("has_boundary"), F.when(has, F.regexp_extract(answer, f"(?s)^(.*{END})(.*)$", 1)).alias("analysis"), F.when(has, strip(F.regexp_extract(answer, f"(?s)^(.*{END})(.*)$", 2))).otherwise(answer).alias("text"))


def verdict(gate: Column, issues: Column) -> Column:
    """'fail' if the gate says short or long, or the issues (array<struct<issue, severity>>) can't be read or hold a high one."""
    high = F.size(F.filter(issues, lambda i: i["severity"] == "high"))
    return F.when(gate.isin("short", "long") | issues.isNull() | (high > 0), "fail").otherwise("pass")


def selected_attempts(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The last attempt of each item, with the number of attempts: later ones replace earlier ones whatever their issues."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    every = Window.partitionBy(key)
    return attempts.select("*", F.row_number().over(last).alias("_r"), F.count("*").over(every).alias("total_attempts")).where("_r = 1").drop("_r")


def next_attempt(attempts: DataFrame, key: str, number: str) -> DataFrame:
    return attempts.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_attempt"))


def message_array(**slots: Column) -> Column:
    """array<struct<role, content>> of the slots that are not null, in order; each context slot is followed by an acknowledgement."""
    parts = []
    for name, content in slots.items():
        role = "system" if name == "system" else "user"
        parts.append(F.when(content.isNotNull(), F.struct(F.lit(role).alias("role"), content.alias("content"))))
        if name not in ("system", "source"):
            parts.append(F.when(content.isNotNull(), F.struct(F.lit("assistant").alias("role"), F.lit("Understood.").alias("content"))))
    return F.filter(F.array(*parts), lambda m: m.isNotNull())


def last_object(text: str) -> str | None:
    """The last balanced {...} of a text: scanning back from its last brace, outside of strings."""
    close = text.rfind("}")
    depth, quoted, at = 0, False, close
    while at >= 0:
        if text[at] == '"':
            slashes = at - len(text[:at].rstrip("\\"))
            quoted ^= slashes % 2 == 0 if quoted else True
        elif not quoted and text[at] in "{}":
            depth += 1 if text[at] == "}" else -1
            if depth == 0:
                return text[at : close + 1]
        at -= 1
    return None


def json_in(answer: str | None) -> str | None:
    """A model's answer without a code fence, or the last object in it."""
    if answer is None:
        return None
    text = answer.strip()
    if text.startswith("```"):
        lines = text.split("\n")[1:]
        text = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines).strip()
    return text if text.startswith("{") else last_object(text) or text


@F.pandas_udf(StringType())
def recovered_json(answers: pd.Series) -> pd.Series:
    return answers.map(json_in)


def parsed(answer: Column, schema: str) -> Column:
    """The object in an answer by a schema; null if there is none that can be read."""
    return F.from_json(recovered_json(answer), schema, {"mode": "PERMISSIVE"})
