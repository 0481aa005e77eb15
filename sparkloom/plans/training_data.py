"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift, nesting, quarantine
from sparkloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the argument objects between a client's files."""
    return drift.drift_log(table(spark, d, "tool_calls"))


def p2_union_schema(spark: SparkSession, d: str) -> DataFrame:
    """The union schema of all files, one row per tool and argument."""
    return drift.union_schema(table(spark, d, "tool_calls"))


def p2_calls(spark: SparkSession, d: str) -> DataFrame:
    """All calls in one consistent table."""
    return drift.unified_calls(table(spark, d, "tool_calls"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Failing lines of session logs and exports with the first reason."""
    return quarantine.failing_lines(table(spark, d, "session_lines"), table(spark, d, "export_lines"))


def p3_session_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sound entries of session logs."""
    return quarantine.session_entries(table(spark, d, "session_lines")).drop("line")


def p3_export_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sound entries of exports."""
    return quarantine.export_entries(table(spark, d, "export_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Child records of messages with their parents, from the keys of the flat tables."""
    records = nesting.read_records(table(spark, d, "session_lines"), with_fields=False)
    return nesting.table_links(nesting.flat_tables(records, nesting.schema_graph(records)))


def p5_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    """Elements of messages and the tables that shared inlining gives them."""
    return nesting.schema_graph(nesting.read_records(table(spark, d, "session_lines"), with_fields=False))


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all flat tables with their keys and fields."""
    records = nesting.read_records(table(spark, d, "session_lines"))
    tables = nesting.flat_tables(records, nesting.schema_graph(records))
    return tables.withColumn("fields", F.to_json("fields")).drop("inlined")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_union_schema, p2_calls, p3_found, p3_session_entries, p3_export_entries, p5_found, p5_schema_graph, p5_tables)
}

SQL: dict[str, str] = {}
