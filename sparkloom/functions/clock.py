"""Clocks and dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_clock(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``; null for anything else."""
    parts = F.split(F.trim(text), ":")
    read = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(parts) <= 3) & F.forall(read, lambda p: p.isNotNull())
    return F.when(good, F.aggregate(read, F.lit(0.0), lambda a, p: a * 60 + p))


def format_clock(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from an hour on; fractions are cut off."""
    whole = seconds.cast("bigint")
    minutes = F.format_string("%02d:%02d", F.floor(whole % 3600 / 60), whole % 60)
    return F.when(whole >= 3600, F.concat(F.format_string("%02d:", F.floor(whole / 3600)), minutes)).otherwise(minutes)


def compact_date(text: Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM-DD``; null for anything else."""
    parts = [F.substr(text, F.lit(at), F.lit(size)) for at, size in ((1, 4), (5, 2), (7, 2))]
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", *parts).try_cast("date").cast("string"))
