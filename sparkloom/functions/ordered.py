"""Looking back along an ordered sequence without holding it in one task.

A sequence (``key``) is cut into blocks of its order column. Windows run inside a block; what crosses
its start comes from one row per block. A hot key is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, key: str, order: list[str], value: Column, block: Column, name: str = "previous") -> DataFrame:
    """``rows`` with the value of the row before in its sequence, null at the start.

    ``block`` must rise with the order; null keys are a sequence of their own.
    """
    blocks = rows.withColumns({"_block": block, "_value": F.struct(value.alias("v"))})
    own = Window.partitionBy(key, "_block").orderBy(*order)
    last = blocks.groupBy(key, "_block").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).drop("_last")
    k, b = F.col(key), F.col("_block")
    carried = carried.select(k.alias("_key"), b.alias("_of"), "_carried")
    joined = blocks.withColumn("_before", F.lag("_value").over(own)).join(carried, k.eqNullSafe(F.col("_key")) & b.eqNullSafe(F.col("_of")), "left")
    return joined.withColumn(name, F.coalesce("_before", "_carried")["v"]).drop("_block", "_value", "_before", "_carried", "_key", "_of")


def with_running_sum(rows: DataFrame, key: str, order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """``rows`` with the sum of a value over its sequence up to each row."""
    blocks = rows.withColumns({"_block": block, "_value": value})
    own = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    k, b = F.col(key), F.col("_block")
    carried = sums.select(k.alias("_key"), b.alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    joined = blocks.withColumn(name, F.sum("_value").over(own)).join(carried, k.eqNullSafe(F.col("_key")) & b.eqNullSafe(F.col("_of")), "left")
    return joined.withColumn(name, F.col(name) + F.col("_carried")).drop("_block", "_value", "_carried", "_key", "_of")
