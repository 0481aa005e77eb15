"""JSON-lines and text files as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, directory: str, glob: str = "*.jsonl") -> DataFrame:
    """``path``, ``line_no`` (from 1) and ``line`` of all matching files below a directory.

    Files are split like any text source; lines are numbered within their split, and every split begins
    where the ones before it in its file end, so no file is held by one task. Bytes that are no UTF-8 are
    dropped. Empty files have no rows.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(directory)
    placed = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("line"),
    )
    numbered = placed.withColumn("own", F.row_number().over(Window.partitionBy("path", "block").orderBy("row")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("own")).cast("bigint").alias("line_no"), "line")


def read_pages(spark: SparkSession, directory: str, glob: str = "*.md", skip: tuple[str, ...] = ("index.md", "log.md")) -> DataFrame:
    """``path``, ``name`` (without suffix), ``body`` and ``modified`` of all pages below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory)
    file_name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~file_name.isin(*skip)).select(
        "path", F.regexp_replace(file_name, r"\.[^.]+$", "").alias("name"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("modified")
    )


def newest_file(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """The newest file whose name matches ``pattern``; equal times by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "modificationTime", "length")
    return files.filter(F.element_at(F.split("path", "/"), -1).rlike(pattern)).orderBy(F.desc("modificationTime"), "path").limit(1)
