"""Subtitle files as cues: WebVTT, SRT, JSON3 and XML (TTML, srv1 to srv3).

A file is one value, so reading it is a narrow step: an Arrow-batched function from text to an array of
(seconds, raw text), exploded and normalised by column expressions.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import caption_text, spoken_text

CUES = T.ArrayType(T.StructType([T.StructField("seconds", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())]))
_CUES = pa.list_(pa.struct([("seconds", pa.float64()), ("text", pa.string()), ("speaker", pa.string())]))
XML_FORMATS = ("ttml", "srv1", "srv2", "srv3")
#: Starts of header and comment lines (fixed values).
NOT_TEXT = ("NOTE", "STYLE", "REGION")


def clock_value(text: str) -> float:
    seconds = 0.0
    for part in text.strip().split(":"):
        seconds = seconds * 60 + float(part)
    return seconds


def cues_of_vtt(text: str) -> list[dict]:
    """Blocks of lines behind a line with an arrow; a blank line ends a block, lines of digits are skipped."""
    cues: list[dict] = []
    block: dict | None = None
    for line in (raw.strip("﻿").strip() for raw in text.splitlines()):
        if "-->" in line:
            block = {"seconds": clock_value(line.split("-->")[0]), "text": []}
            cues.append(block)
        elif not line:
            block = None
        elif block is not None and line != "WEBVTT" and not line.startswith(NOT_TEXT) and not re.fullmatch(r"\d+", line):
            block["text"].append(line)
    return [c | {"text": " ".join(c["text"])} for c in cues if c["text"]]


def cues_of_json3(text: str) -> list[dict]:
    events = [e for e in json.loads(text).get("events", []) if e.get("segs")]
    return [{"seconds": float(e.get("tStartMs", 0)) / 1000, "text": "".join(s.get("utf8", "") for s in e["segs"])} for e in events]


def cues_of_xml(text: str, podcast: bool = False) -> list[dict]:
    """Elements ``p`` and ``text`` of any namespace with a start: ``begin`` (clock), ``t`` (ms) or ``start``. In the
    transcript of a podcast all ``p`` count, and one without ``begin`` starts at 0."""
    cues = []
    for element in ElementTree.fromstring(text).iter():
        names = {key.rpartition("}")[2]: value for key, value in element.attrib.items()}
        tag = element.tag.rpartition("}")[2]
        if (podcast and tag == "p") or (tag in ("p", "text") and {"begin", "t", "start"} & names.keys()):
            at = clock_value(names.get("begin", "0")) if podcast else clock_value(names["begin"]) if "begin" in names else float(names["t"]) / 1000 if "t" in names else float(names["start"])
            said = [t.strip() for t in element.itertext() if t.strip()]
            cues.append({"seconds": at, "text": " ".join(said), "speaker": names.get("agent")})
    return cues


def cues_of(extension: str | None, payload: str | None, podcast: bool = False) -> list[dict] | None:
    """Raw cues of a file; None if its format is unknown or it can't be read."""
    try:
        if payload is None:
            return None
        if extension in ("vtt", "srt"):
            return cues_of_vtt(payload.replace(",", ".") if extension == "srt" else payload)
        if extension == "json3":
            return cues_of_json3(payload)
        return cues_of_xml(payload, podcast) if extension in XML_FORMATS else None
    except (ValueError, AttributeError, TypeError, ElementTree.ParseError):
        return None


def read_cues(extension: Column, payload: Column, podcast: bool = False) -> Column:
    """Array of raw cues of each file."""

    @F.arrow_udf(CUES)
    def read(extensions: pa.Array, payloads: pa.Array) -> pa.Array:
        return pa.array([cues_of(e, p, podcast) for e, p in zip(extensions.to_pylist(), payloads.to_pylist())], _CUES)

    return read(F.lower(extension), payload)


def parse_subtitles(files: DataFrame, podcast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cues (``doc_id``, ``seq``, ``seconds``, ``text``, ``speaker``) of ``files`` (``doc_id``, ``ext``,
    ``payload``), and the files that can't be read. Cues whose normal form is empty are left out."""
    read = files.withColumn("cues", read_cues(F.col("ext"), F.col("payload"), podcast))
    rows = read.select("doc_id", F.posexplode("cues").alias("seq", "c")).select("doc_id", "seq", "c.seconds", "c.text", "c.speaker")
    form = spoken_text if podcast else caption_text
    return rows.withColumn("text", form(F.col("text"))).filter(F.col("text") != ""), read.filter(F.col("cues").isNull()).drop("cues")


def xml_language(payload: Column) -> Column:
    """Attribute ``xml:lang`` of the root of a TTML file."""
    return F.nullif(F.regexp_extract(payload, r"<(?:\w+:)?tt\b[^>]*\bxml:lang=[\"']([^\"']*)", 1), F.lit(""))
