"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import encoding, packing, runs, stuffing, turns
from sparkloom.session import stored, table


def _talks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "transcript_lines"), table(spark, d, "episode_cast"), table(spark, d, "speakers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns of every recording, by their first and last line."""
    return turns.speaker_turns(*_talks(spark, d), with_text=False).select("doc_id", "turn_no", "speaker_id", "first_line", "last_line")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the time of their first line and their clean text."""
    return turns.speaker_turns(*_talks(spark, d)).select("doc_id", "turn_no", "speaker_id", "seconds", "text")


def p1_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Mined layouts of transcript lines and of stamps with their slots."""
    read = stored(turns.read_lines(*_talks(spark, d), with_text=False))
    texts = turns.line_layouts(read).select(F.lit("text").alias("of"), "layout", "n_lines", "clock_slot", "speaker_slot").distinct()
    stamps = turns.stamp_layouts(read).select(F.lit("stamp").alias("of"), F.col("stamp").alias("layout"), "n_lines", F.col("slots").isNotNull().alias("clock_slot"), F.lit(False).alias("speaker_slot"))
    return texts.unionByName(stamps)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more alike cues."""
    collapsed = runs.collapse_runs(table(spark, d, "cues"))
    return collapsed.filter("n_events > 1").select("doc_id", "first_seq", "last_seq")


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    """One event per run, with count and duration."""
    return runs.collapse_runs(table(spark, d, "cues"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_documents(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come back from the token ids."""
    ids = encoding.token_ids(F.col("text"))
    return table(spark, d, "documents").select("doc_id", encoding.decoded_text(ids).alias("text"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Token ids with the characters and bytes that each covers."""
    return table(spark, d, "documents").select("doc_id", encoding.token_offsets(F.col("text")).alias("t")).select("doc_id", "t.*")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens for all documents."""
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: number, tokens and space left over in all."""
    used = packing.pack_documents(table(spark, d, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum(packing.CAPACITY - F.col("used")).alias("left_over"), F.max("used").alias("fullest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of keywords, links or tags instead of sentences."""
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id").distinct()


def p8_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every page."""
    return table(spark, d, "documents").select("doc_id", stuffing.page_measures(F.col("text")).alias("m")).select("doc_id", "m.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_turns, p1_layouts, p4_found, p4_events, p6_ids, p6_decoded, p6_offsets, p7_containers, p7_fill, p8_found, p8_measures)
}

SQL = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
