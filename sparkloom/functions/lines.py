"""Functions of texts as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.constants import BODY_LINES, HITS_PER_FILE, OUTPUT_CHARS


def body_lines(text: Column) -> Column:
    """Lines of a text, one line end at its close left out."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def numbered(text: Column, start: Column | int = 1) -> Column:
    """Lines led by their number and a tab."""
    first = F.lit(start) if isinstance(start, int) else start
    return F.array_join(F.transform(body_lines(text), lambda line, i: F.concat((first + i).cast("string"), F.lit("\t"), line)), "\n")


def shortened(text: Column, most: int = BODY_LINES) -> Column:
    """The first ``most`` lines, with a note of how many there are if more."""
    lines = body_lines(text)
    head = F.array_join(F.slice(lines, 1, most), "\n")
    note = F.concat(F.lit(f"\n(first {most} of "), F.size(lines).cast("string"), F.lit(" lines)"))
    return F.when(F.size(lines) > most, F.concat(head, note)).otherwise(head)


def capped(text: Column, most: int = OUTPUT_CHARS) -> Column:
    """A text of at most ``most`` characters, cut at its last blank line if that lies past the half, else
    at its last line end."""
    cut = F.substr(text, F.lit(1), F.lit(most))
    blank = F.lit(most) - F.locate("\n\n", F.reverse(cut)) - 1
    line = F.lit(most) - F.locate("\n", F.reverse(cut))
    at = F.when((F.locate("\n\n", F.reverse(cut)) > 0) & (blank > most / 2), blank).when(F.locate("\n", F.reverse(cut)) > 0, line).otherwise(0)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substr(cut, F.lit(1), at), F.lit("\n\n… (output truncated)")))


def literal_hits(texts: DataFrame, key: str, literal: str, most: int | None = HITS_PER_FILE, in_all: int | None = None) -> DataFrame:
    """Lines that contain ``literal``: the key, ``line_no`` and ``line``; the first ``most`` of each text, and for a
    report the first ``in_all`` by key."""
    holding = texts.filter(F.contains("text", F.lit(literal)))
    lines = holding.select(key, F.posexplode(body_lines(F.col("text"))).alias("i", "line"))
    hits = lines.filter(F.contains("line", F.lit(literal))).select(key, (F.col("i") + 1).alias("line_no"), "line")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
        hits = hits.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    return hits if in_all is None else hits.orderBy(key, "line_no").limit(in_all)


def sources_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source of each node: ``id`` and ``code``, the lines of its file's text (``path``, ``text``) from ``start_line`` to
    ``end_line``; nodes that start behind the end of their file have none.

    A file is one value, so its lines are cut out of it and never joined one by one.
    """
    joined = nodes.select("id", F.col("file_path").alias("path"), "start_line", "end_line").join(texts.select("path", "text"), "path")
    size = F.col("end_line") - F.col("start_line") + 1
    held = joined.withColumn("lines", body_lines(F.col("text"))).filter(F.size("lines") >= F.col("start_line"))
    return held.select("id", F.array_join(F.slice("lines", F.col("start_line"), F.greatest(size, F.lit(0))), "\n").alias("code"))
