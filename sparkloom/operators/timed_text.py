"""Cues of timed text: leaving out repeats, merging fragments, rendering.

Cues have ``doc_id``, ``seq``, ``seconds`` and ``text``. Defined cases: null and empty texts are left
out where texts are merged; equal times are ordered by ``seq``; cues delivered again count once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.clock import format_clock
from sparkloom.functions.ordered import with_previous, with_running_sum
from sparkloom.functions.text import quoted
from sparkloom.session import stored

#: Longest gap in seconds, from the start of a merged cue, and most words of one that still grows.
GAP = 3.2
WORDS = 80
#: Length of a block of a recording in seconds.
BLOCK = 600
#: Cues of a recording that are folded at once.
PIECE = 512

ORDER = ["seconds", "seq"]


def _block(seconds: Column) -> Column:
    return F.floor(F.coalesce(seconds, F.lit(0.0)) / BLOCK)


def distinct_cues(cues: DataFrame) -> DataFrame:
    """Cues once, without null or empty texts and null times."""
    return cues.select("doc_id", "seq", "seconds", "text").filter((F.col("text") != "") & F.col("seconds").isNotNull()).distinct()


def drop_repeats(cues: DataFrame) -> DataFrame:
    """Cues without those whose text equals that of the cue before; repeats further apart stay."""
    seen = with_previous(cues, "doc_id", ORDER, F.col("text"), _block(F.col("seconds")), "before")
    return seen.filter(~F.col("text").eqNullSafe(F.col("before"))).drop("before")


def appended(text: str, more: str) -> str:
    """``text`` with what ``more`` adds: nothing if it is contained, else its words behind the longest
    overlap of the end of one with the start of the other."""
    if not text or more in text:
        return text or more
    own, new = ([re.sub(r"[^\w']+", "", w.lower()) for w in t.split()] for t in (text, more))
    overlap = next((n for n in range(min(len(own), len(new)), 0, -1) if own[-n:] == new[:n]), 0)
    rest = more.split()[overlap:]
    return " ".join([text, *rest])


def merged(cues: list[dict], carried: dict | None = None) -> list[dict]:
    """Fragments folded in order: a cue joins the one being built if it starts at most ``GAP`` behind its
    start, the text built so far ends no sentence and has fewer than ``WORDS`` words. ``carried`` is one
    already being built."""
    out: list[dict] = [dict(carried)] if carried else []
    for cue in cues:
        now = out[-1] if out else None
        if now and cue["seconds"] - now["seconds"] <= GAP and now["text"][-1:] not in (".", "!", "?") and len(now["text"].split()) < WORDS:
            joined = " ".join(appended(now["text"], cue["text"]).split())
            now["text"] = re.sub(r"\s+([,.;:!?])", r"\1", joined)
        else:
            out.append(dict(cue))
    return out


_CUE = T.StructType([T.StructField("seconds", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])
_FOLDED = T.StructType([T.StructField("closed", T.ArrayType(_CUE)), T.StructField("open", _CUE)])
_CUE_ARROW = pa.struct([("seconds", pa.float64()), ("seq", pa.int64()), ("text", pa.string())])


def _folded(cues: Column, carried: Column) -> Column:
    """What a piece closes when a cue is carried into it, and what it leaves open."""

    @F.arrow_udf(_FOLDED)
    def fold(pieces: pa.Array, before: pa.Array) -> pa.Array:
        folds = [merged(own, open_one) for own, open_one in zip(pieces.to_pylist(), before.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[:-1] for f in folds], pa.list_(_CUE_ARROW)), pa.array([f[-1] for f in folds], _CUE_ARROW)], ["closed", "open"])

    return fold(cues, carried)


def merge_fragments(cues: DataFrame, piece: int = PIECE) -> DataFrame:
    """Merged cues: ``doc_id``, ``seq`` and ``seconds`` of the first fragment, and ``text``.

    A recording is folded in pieces of ``piece`` cues. Each is folded as if nothing came before it; then
    what a piece leaves open is carried into the next one, and pieces whose carried cue has changed are
    folded again until none has. Cuts mostly fall in the same places again within a few cues, so that two
    rounds do; whatever the rounds, no task holds more than its pieces.
    """
    numbered = with_running_sum(cues, "doc_id", ORDER, F.lit(1), _block(F.col("seconds")), "n")
    cue = F.struct(F.col("seconds").cast("double").alias("seconds"), F.col("seq").cast("bigint").alias("seq"), "text")
    pieces = stored(numbered.groupBy("doc_id", F.floor((F.col("n") - 1) / piece).alias("piece")).agg(F.array_sort(F.collect_list(cue)).alias("cues")))
    nothing = F.lit(None).cast(_CUE)
    folds = stored(pieces.withColumn("carried", nothing).select("doc_id", "piece", "carried", _folded(F.col("cues"), F.col("carried")).alias("f")))
    along = Window.partitionBy("doc_id").orderBy("piece")
    while True:
        ahead = folds.withColumn("before", F.lag("f.open").over(along))
        same = F.col("before").eqNullSafe(F.col("carried"))
        changed = stored(ahead.filter(~same).select(F.col("doc_id").alias("of"), F.col("piece").alias("at"), "before"))
        if changed.isEmpty():
            break
        again = pieces.join(changed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at")))
        refolded = again.select("doc_id", "piece", F.col("before").alias("carried"), _folded(F.col("cues"), F.col("before")).alias("f"))
        folds = stored(ahead.filter(same).drop("before").unionByName(refolded))
    last = F.lead("piece").over(along).isNull()
    ends = folds.withColumn("ends", F.when(last, F.array("f.open")).otherwise(F.array().cast(T.ArrayType(_CUE))))
    return ends.select("doc_id", F.explode(F.concat("f.closed", "ends")).alias("c")).select("doc_id", "c.seq", "c.seconds", "c.text")


def finished(cues: DataFrame) -> DataFrame:
    """Cues without repeats, merged, with their clock ``timestamp``."""
    return merge_fragments(drop_repeats(distinct_cues(cues))).withColumn("timestamp", format_clock(F.col("seconds")))


def markdown_line(timestamp: Column, text: Column, speaker: Column | None = None) -> Column:
    """``- [ts] speaker: text``, the speaker only if there is one."""
    who = F.lit("") if speaker is None else F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise("")
    return F.concat(F.lit("- ["), timestamp, F.lit("] "), who, text)


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter with JSON-quoted values."""
    lines = [F.concat(F.lit(f"{name}: "), quoted(value)) for name, value in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))
