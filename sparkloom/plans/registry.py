"""All queries of the library and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import ship

MODULES = ("logs", "graph", "parts", "timed_text", "pages", "training_data")


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"sparkloom.plans.{name}") for name in MODULES]


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the executors before it."""

    @functools.wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship(spark)
        return query(spark, directory)

    return run


def collect_queries(sources: list) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(q) for m in sources for name, q in m.QUERIES.items()}


def collect_sql(sources: list) -> dict[str, str]:
    return {name: q for m in sources for name, q in m.SQL.items()}
