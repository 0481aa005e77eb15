"""Incremental refresh of tables from files that come, change and go, with Structured Streaming.

Every micro-batch compares the listing of the files (path, time, length) with that of the last refresh
by anti-joins, reads only those that are new or rewritten, and replaces or deletes their rows. The
tables are parquet folders partitioned by a hash bucket of the file; only buckets that a refresh
touches are read and overwritten, so it costs as much as what changed. The rows of a bucket are
checkpointed before it is overwritten.

Defined cases: an empty file is listed by no scan and counts as deleted; a file that parses to no rows is
kept in the listing; a file rewritten within the same instant to the same length is taken for unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.session import cut

BUCKETS = 64
LISTING = "file_path string, modified timestamp, length bigint"


def with_bucket(rows: DataFrame, key: str = "file_path", buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _table(spark: SparkSession, folder: str, schema: object) -> DataFrame:
    """The table at a folder, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_files(batch: DataFrame, folder: str, key: str = "file_path", removed: DataFrame | None = None) -> None:
    """Replace the rows of all files in ``batch`` in the table at ``folder``, and delete those of the files
    (column ``key``) of ``removed``."""
    spark = batch.sparkSession
    changes = cut(with_bucket(batch, key))
    gone = changes.select("bucket", key)
    gone = cut((gone if removed is None else gone.unionByName(with_bucket(removed.select(key), key).select("bucket", key))).distinct())
    touched = gone.select("bucket").distinct()
    existing = _table(spark, folder, changes.schema)
    kept = existing.join(touched, "bucket", "left_semi").join(gone, ["bucket", key], "left_anti")
    refreshed = cut(kept.select(*changes.columns).unionByName(changes))
    refreshed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    # at most BUCKETS numbers: an overwrite leaves a bucket alone that has no rows any more
    for row in touched.join(refreshed.select("bucket").distinct(), "bucket", "left_anti").collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={row.bucket}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refresh(spark: SparkSession, source: str, folder: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*", key: str = "file_path") -> None:
    """Bring the table at ``folder`` up to date with the files below ``source``; see :func:`follow_files`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    listing = cut(files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), "length"))
    listed = f"{folder}_files"
    before = cut(_table(spark, listed, f"{LISTING}, bucket int").drop("bucket"))
    changed = cut(listing.join(before, ["file_path", "modified", "length"], "left_anti"))
    deleted = cut(before.join(listing, "file_path", "left_anti").select("file_path"))
    if changed.isEmpty() and deleted.isEmpty():
        return
    oldest = changed.agg(F.min("modified")).first()[0]
    # the time is pushed to the scan, so that older files are not read
    recent = files if oldest is None else files.filter(F.col("modificationTime") >= F.lit(oldest))
    read = recent.join(changed.select(F.col("file_path").alias("path")), "path", "left_semi")
    texts = read.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    removed = changed.select("file_path").unionByName(deleted)
    replace_files(parse(texts), folder, key, removed.withColumnRenamed("file_path", key))
    replace_files(changed, listed, removed=removed)


def follow_files(spark: SparkSession, source: str, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*", key: str = "file_path", continuous: bool = False, seconds: float = 1) -> StreamingQuery:
    """Start a query that keeps the table at ``folder`` up to date with the files below ``source``.

    ``parse`` turns files (``file_path``, ``text``, ``modified``) into rows that keep the file as ``key``. Unless
    ``continuous``, the query ends after one refresh. A stream of ticks drives it: a file source would
    miss what is rewritten or deleted. A failed refresh ends the query, and its ``exception`` tells why.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, _: refresh(batch.sparkSession, source, folder, parse, glob, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if continuous else writer.trigger(availableNow=True)).start()
