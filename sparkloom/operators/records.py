"""Small transforms of records: shell commands, questions, findings, prompts.

All are column expressions over one row, save the walk of a syntax tree, an Arrow-batched function.
Null inputs give null or empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.json_text import BROKEN, parse_strict

#: Programs to avoid and what to take instead, in order (fixed values).
ALTERNATIVES = {"find": "fd", "grep": "rg"}
#: Least score of a finding to be kept (fixed value).
GATE = 80


def swapped_commands(text: Column, alternatives: dict[str, str] = ALTERNATIVES) -> Column:
    """Text with the programs to avoid replaced as whole words."""
    for old, new in alternatives.items():
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return text


def shell_programs(command: Column) -> Column:
    """Programs of a shell command without a syntax tree: the first word of each of its parts, base name only."""
    parts = F.split(F.coalesce(command, F.lit("")), r"[|;&()\n`]+|\$\(")
    words = F.transform(parts, lambda p: F.regexp_extract(F.regexp_extract(p, r"^\s*(\S+)", 1), "[^/]*$", 0))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def tree_programs(tree: Column) -> Column:
    """Names of all ``Command`` nodes of a syntax tree given as JSON."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def names(batch: pa.Array) -> pa.Array:
        out = []
        for text in batch.to_pylist():
            found: dict[str, None] = {}
            value = parse_strict(text) if text else None
            stack = [] if value is BROKEN else [value]
            while stack:
                node = stack.pop()
                if isinstance(node, dict):
                    name = node.get("name")
                    if node.get("type") == "Command" and isinstance(name, dict) and isinstance(name.get("value"), str):
                        found[name["value"]] = None
                    stack.extend(reversed(node.values()))
                elif isinstance(node, list):
                    stack.extend(reversed(node))
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return names(tree)


def discouraged(programs: Column, alternatives: dict[str, str] = ALTERNATIVES) -> Column:
    """The programs to avoid that are used, in the order of the list."""
    return F.array_intersect(F.array(*map(F.lit, alternatives)), programs)


def warning(used: Column, alternatives: dict[str, str] = ALTERNATIVES) -> Column:
    """Note on discouraged programs; empty without any."""
    better = F.create_map(*[F.lit(x) for pair in alternatives.items() for x in pair])
    names = F.array_join(F.transform(used, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), " and ")
    others = F.array_join(F.transform(used, lambda n: F.concat(F.lit("'"), better[n], F.lit("'"))), " and ")
    return F.when(F.size(used) > 0, F.concat(F.lit("[warning] this command used "), names, F.lit("; prefer "), others)).otherwise("")


def clean_list(values: Column) -> Column:
    """Values trimmed, without blanks and repeats, in their order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def questions(calls: DataFrame, tool: str = "ask_user") -> DataFrame:
    """Questions of calls (``path``, ``line_no``, ``name``, ``args`` VARIANT): ``number`` from 1, ``label``
    (else ``Q`` and the number), ``options`` and whether at most one of them is recommended."""
    asked = calls.filter(F.col("name") == tool).select("path", "line_no", F.posexplode(F.try_variant_get("args", "$.questions", "array<variant>")).alias("i", "q"))
    options = F.coalesce(F.try_variant_get("q", "$.options", "array<variant>"), F.array().cast("array<variant>"))
    recommended = F.size(F.filter(options, lambda o: F.coalesce(F.try_variant_get(o, "$.recommended", "boolean"), F.lit(False))))
    label = F.coalesce(F.nullif(F.try_variant_get("q", "$.label", "string"), F.lit("")), F.concat(F.lit("Q"), (F.col("i") + 1).cast("string")))
    return asked.select("path", "line_no", (F.col("i") + 1).alias("number"), label.alias("label"), F.size(options).alias("options"), (recommended <= 1).alias("valid"))


def labelled_answers(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers (``id``, ``value``) with the label of their question, else its id."""
    return answers.join(asked.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def gated_findings(findings: DataFrame, gate: int = GATE) -> DataFrame:
    """Findings (``axis``, ``severity``, ``score``) kept: those of ``gate`` or more, and those without a severity,
    which are judgement calls. Where the findings say whether they are ``unambiguous``, P3 only if so."""
    kept = findings.filter((F.col("score") >= gate) | F.col("severity").isNull())
    if "unambiguous" in findings.columns:
        kept = kept.filter(F.col("severity").isNull() | (F.col("severity") != "P3") | F.col("unambiguous"))
    return kept


def verdict(score: Column) -> Column:
    """Band of a score from 0 to 10."""
    return F.when(score >= 8, "good").when(score >= 5, "fair").otherwise("poor")


def duration_class(seconds: Column) -> Column:
    """Short below 5 minutes, long above 20."""
    return F.when(seconds < 300, "short").when(seconds > 1200, "long").otherwise("medium")


def relaxed(rows: DataFrame, conditions: list[Column], order: list, n: int) -> DataFrame:
    """The first ``n`` rows that meet all conditions; if there are none, the last condition is dropped, and so on."""
    for kept in range(len(conditions), -1, -1):
        found = rows
        for condition in conditions[:kept]:
            found = found.filter(condition)
        found = found.orderBy(*order).limit(n)
        if kept == 0 or not found.isEmpty():
            return found
    raise AssertionError
