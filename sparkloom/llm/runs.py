"""Collapsing runs of identical or near-identical consecutive events.

The order of a sequence is cut into range-sorted chunks. Every chunk is read once and encoded into
run summaries; a summary is associative: two of them join if the last event of the first and the
first event of the second are alike. Only the first and the last run of a chunk can go on in its
neighbours, so these alone meet in a prefix merge per sequence: at most two rows a chunk, whatever
the length of the sequence. No sequence is ever held by one task.

Likeness is that of neighbours: case, punctuation, spacing, markup and entities are set aside, and at
most one word in five of the longer text may be added, dropped or changed. Texts with different
figures are never alike.

Defined cases: events with null text or without a word are left out first; equal ``seconds`` are
ordered by ``seq``, null ``seconds`` come last; a row delivered again (same recording, ``seconds``,
``seq`` and text) counts once; a null ``doc_id`` is a sequence of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import cut

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<\d[\d:.]*>|\{\\[^{}]*\}")
_NOT_WORD = re.compile(r"[^\w\s]+")
_FIGURES = re.compile(r"\d+")


def caption_words(text: str | None) -> list[str]:
    """Words of a caption without case, punctuation, markup and entities."""
    if not text:
        return []
    plain = _NOT_WORD.sub("", _TAG.sub(" " if "<br" in text else "", html.unescape(text)).casefold())
    return [w for w in plain.split() if w.strip("_")]


def alike(a: list[str], b: list[str], share: int = 5) -> bool:
    """At most one word in ``share`` of the longer list is added, dropped or changed, and no figure."""
    if a == b:
        return True
    if [f for w in a for f in _FIGURES.findall(w)] != [f for w in b for f in _FIGURES.findall(w)]:
        return False
    most = max(len(a), len(b)) // share
    if abs(len(a) - len(b)) > most:
        return False
    start = next((i for i, (x, y) in enumerate(zip_longest(a, b)) if x != y), 0)
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


RUNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("first_seq", T.IntegerType()),
        T.StructField("last_seq", T.IntegerType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("start_seconds", T.DoubleType()),
        T.StructField("end_seconds", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("first_words", T.StringType()),
        T.StructField("last_words", T.StringType()),
        T.StructField("opens", T.BooleanType()),
        T.StructField("closes", T.BooleanType()),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("chunk", pa.int32()), ("run", pa.int32()), ("first_seq", pa.int32()), ("last_seq", pa.int32()),
        ("n_events", pa.int64()), ("start_seconds", pa.float64()), ("end_seconds", pa.float64()), ("text", pa.string()),
        ("first_words", pa.string()), ("last_words", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()),
    ]
)


def _encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted chunk. ``opens`` and ``closes`` mark those at its ends, which keep their words."""
    chunk = TaskContext.get().partitionId()
    current: dict | None = None
    first, last, before, number = [], [], None, 0

    def closed(at_end: bool) -> dict:
        ends = current["opens"] or at_end
        return current | {"first_words": " ".join(first) if ends else None, "last_words": " ".join(last) if ends else None, "closes": at_end}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = (row["doc_id"], row["seconds"], row["seq"], row["text"])
            words = caption_words(row["text"])
            if key == before or not words:
                continue
            before = key
            same = current is not None and current["doc_id"] == row["doc_id"]
            if same and alike(last, words):
                current |= {"last_seq": row["seq"], "n_events": current["n_events"] + 1, "end_seconds": row["seconds"]}
            else:
                if current is not None:
                    out.append(closed(not same))
                number += 1
                current = {
                    "doc_id": row["doc_id"], "chunk": chunk, "run": number, "first_seq": row["seq"], "last_seq": row["seq"],
                    "n_events": 1, "start_seconds": row["seconds"], "end_seconds": row["seconds"], "text": row["text"], "opens": not same,
                }
                first = words
            last = words
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
    if current is not None:
        yield pa.RecordBatch.from_pylist([closed(True)], _ARROW)


def _alike_strings(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x is not None and y is not None and alike(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def collapse_runs(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """One event per run of ``events`` (``doc_id``, ``seq``, ``seconds``, ``text``; others are ignored).

    Columns: ``doc_id``, ``first_seq``, ``last_seq``, ``n_events``, ``start_seconds``, ``duration``
    and ``text`` (of the first event). ``chunks`` is the number of range-sorted chunks; by default the
    session's number of shuffle partitions.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("seconds").asc_nulls_last(), F.col("seq").asc_nulls_last(), F.col("text")]
    kept = events.select(F.col("doc_id").cast("bigint"), F.col("seconds").cast("double"), F.col("seq").cast("int"), "text").filter(F.trim("text") != "")
    ranged = kept.repartitionByRange(chunks, *order[:3]) if chunks else kept.repartitionByRange(*order[:3])
    runs = cut(ranged.sortWithinPartitions(*order).mapInArrow(_encode_chunk, RUNS))

    whole = runs.filter(~(F.col("opens") | F.col("closes")))
    same = F.arrow_udf(_alike_strings, T.BooleanType())
    along = Window.partitionBy("doc_id").orderBy("chunk", "run")
    ends = (
        runs.filter(F.col("opens") | F.col("closes"))
        .withColumn("words_before", F.when(F.lag("chunk").over(along) < F.col("chunk"), F.lag("last_words").over(along)))
        .withColumn("joins", F.col("opens") & same("words_before", "first_words"))
        .withColumn("joined", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    )
    position = F.struct("chunk", "run")
    merged = ends.groupBy("doc_id", "joined").agg(
        F.min_by("first_seq", position).alias("first_seq"),
        F.max_by("last_seq", position).alias("last_seq"),
        F.sum("n_events").alias("n_events"),
        F.min_by("start_seconds", position).alias("start_seconds"),
        F.max_by("end_seconds", position).alias("end_seconds"),
        F.min_by("text", position).alias("text"),
    )
    columns = ["doc_id", "first_seq", "last_seq", "n_events", "start_seconds", (F.col("end_seconds") - F.col("start_seconds")).alias("duration"), "text"]
    return whole.select(*columns).unionByName(merged.select(*columns))
