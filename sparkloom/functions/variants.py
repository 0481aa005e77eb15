"""VARIANT helpers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def last_of_repeated_keys(spark: SparkSession) -> None:
    """Make the session read an object that repeats a key, with the last value of it; else it is no JSON."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def whole_json(line: Column) -> Column:
    """VARIANT of a text that is one JSON value; null if it isn't.

    Spark's parser stops behind the first value, so the text is read as the first of two elements; the
    second, a hash of the text, comes out last only if the text is a single value.
    """
    mark = F.concat(F.lit("="), F.xxhash64(line).cast("string"))
    pair = F.try_parse_json(F.concat(F.lit("["), line, F.lit(',"'), mark, F.lit('"]')))

    def first(read: Column) -> Column:
        single = (F.try_variant_get(read, "$[1]", "string") == mark) & F.try_variant_get(read, "$[2]", "variant").isNull()
        return F.when(single, F.try_variant_get(read, "$[0]", "variant"))

    return F.get(F.transform(F.array(pair), first), F.lit(0))  # the lambda's variable holds what is parsed once


def objects_of(line: Column) -> Column:
    """The JSON object of a line as rows to generate: one, or none. What is read from a generated column
    is never merged with the parsing, so each line is parsed once."""
    return F.explode(F.filter(F.array(whole_json(line)), lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))))
