"""Joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored

SALTS = 16
#: Rows of a key that one task takes in :func:`block_join`.
BLOCK = 1 << 18
#: Rows up to which the size of a written table may decide for a broadcast. Ids take a small part of their memory in a
#: file, so that Spark's check would let the driver gather millions of rows.
FEW = 100_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a large ``left`` with a ``right`` of few rows per key, whatever share of ``left`` a key holds.

    Rows of one key are spread by the hash of ``spread`` over ``salts`` tasks, and ``right`` is repeated
    for each. Key columns are matched by equality, so null keys meet nothing.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, keys: list[str], position: Column, last: str, how: str = "left", block: int = BLOCK) -> DataFrame:
    """Join ``left`` with a ``right`` of one row per key whose column ``last`` is the highest ``position`` of the
    key in ``left``.

    Rows of a key are spread by blocks of their position, and ``right`` is repeated only for the blocks
    that its key has: mostly one.
    """
    spread = left.withColumn("_block", F.coalesce(F.floor(position / block), F.lit(0)).cast("bigint"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.coalesce(F.floor(F.col(last) / block).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint")))
    return spread.join(right.withColumn("_block", F.explode(blocks)).drop(last), [*keys, "_block"], how).drop("_block")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows for a join: above ``FEW`` it is not broadcast, whatever the size of its file."""
    return df.hint("merge") if rows > FEW else df


def hubs_of(left: DataFrame, key: str, block: int = BLOCK) -> DataFrame | None:
    """Keys with more than ``block`` rows and the number of ``_salts`` over which these are spread; None without any."""
    counted = left.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_salts")).filter("_salts > 1")
    found = stored(counted)
    return None if found.isEmpty() else found


def hub_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hubs: DataFrame | None, rows: int) -> DataFrame:
    """Inner join of a large ``left`` with ``rows`` rows of ``right``: only rows of ``hubs`` (of :func:`hubs_of`) are spread
    by the hash of ``spread``, and only their partners are repeated. More than ``FEW`` are never broadcast.
    """
    on = [key]
    if hubs is not None:
        salts = F.coalesce("_salts", F.lit(1))
        left = left.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
        right = right.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        on.append("_salt")
    return left.join(sized(right, rows), on).drop("_salt")


def several(left: DataFrame, key: str) -> bool:
    """Whether a key has more than two rows on average: with fewer, lists of them cost more than they save."""
    rows, keys = left.agg(F.count(F.lit(1)), F.approx_count_distinct(key)).first()
    return rows > 2 * keys


def hub_lists(left: DataFrame, key: str, value: str, hubs: DataFrame | None) -> DataFrame:
    """``left`` with what a key leads to (``value``) in one list, for ``hubs`` (of :func:`hubs_of`) in one list a salt."""
    on = [key]
    if hubs is not None:
        left = left.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(value), F.coalesce("_salts", F.lit(1))).cast("int"))
        on.append("_salt")
    kind = left.schema[value].dataType.simpleString()
    null = F.when(F.bool_or(F.col(value).isNull()), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    return left.filter(F.col(key).isNotNull()).groupBy(*on).agg(F.concat(F.collect_list(value), null).alias(value))


def near_join(lists: DataFrame, right: DataFrame, key: str, value: str, hubs: DataFrame | None, rows: int) -> DataFrame:
    """Inner join of ``lists`` (of :func:`hub_lists`) with ``rows`` rows of ``right``, one row for each ``value``.

    More than ``FEW`` rows meet their lists in ranges of the key: what keys of one range lead to can then be
    aggregated before it is shuffled, which leaves little of it if they lead to the same.
    """
    on = [key]
    if hubs is not None:
        right = right.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        on.append("_salt")
    if rows <= FEW:
        met = lists.join(right, on)
    else:
        own = lists.withColumn("_own", F.lit(True))
        both = own.unionByName(right.filter(F.col(key).isNotNull()).withColumn("_own", F.lit(False)), allowMissingColumns=True)
        near = both.repartitionByRange(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
        before = Window.partitionBy(*on).orderBy(F.desc("_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = near.withColumn(value, F.first(value, ignorenulls=True).over(before)).filter("not _own").drop("_own")
    return met.withColumn(value, F.explode(value)).drop("_salt")
