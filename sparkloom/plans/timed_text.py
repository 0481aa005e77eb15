"""Queries of timed text over cues and documents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import clock, scores, text
from sparkloom.operators import timed_text
from sparkloom.session import table
from sparkloom.sources import subtitles

PREFERRED = ["de", "pt_BR", "fr"]
DETECTED = "en"


def dedupe_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return timed_text.drop_repeats(timed_text.distinct_cues(table(spark, d, "cues"))).select("doc_id", "seq")


def gap_merge(spark: SparkSession, d: str) -> DataFrame:
    return timed_text.finished(table(spark, d, "cues")).select("doc_id", "seq", "timestamp", "text")


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return timed_text.distinct_cues(table(spark, d, "cues")).select("doc_id", "seq", text.spoken_text(F.col("text")).alias("text"))


def html_strip_unescape(spark: SparkSession, d: str) -> DataFrame:
    return timed_text.distinct_cues(table(spark, d, "cues")).select("doc_id", "seq", text.caption_text(F.col("text")).alias("text"))


def token_normalize(spark: SparkSession, d: str) -> DataFrame:
    tokens = timed_text.distinct_cues(table(spark, d, "cues")).select(F.explode(text.caption_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def clock_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("o_orderkey") * 7
    shown = table(spark, d, "orders").select("o_orderkey", clock.format_clock(seconds).alias("clock"))
    return shown.withColumn("seconds", clock.parse_clock(F.col("clock")))


def candidate_best(spark: SparkSession, d: str) -> DataFrame:
    formats = F.array(*[F.lit(f) for f in ("json3", "srv3", "ttml", "srv2", "srv1", "vtt", "srt")])
    kind = F.when(F.col("source").isin("wiki", "readme"), "manual").otherwise("automatic")
    rows = table(spark, d, "documents").select("space", kind.alias("source_kind"), F.coalesce("lang", F.lit("und")).alias("language"), F.get(formats, (F.col("doc_id") % 7).cast("int")).alias("ext"), F.col("doc_id").alias("ordinal"))
    return scores.best_candidates(rows, "space", PREFERRED, DETECTED).select("space", "ordinal", "score")


def markdown_transcript(spark: SparkSession, d: str) -> DataFrame:
    cues = table(spark, d, "cues").select("doc_id", "seq", "seconds", "text", "speaker").filter("text <> ''").distinct()
    return cues.select("doc_id", "seq", timed_text.markdown_line(clock.format_clock(F.col("seconds")), F.col("text"), F.col("speaker")).alias("line"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    fields = {name: F.col(name).cast("string") for name in ("source", "lang", "space")}
    return table(spark, d, "documents").select("doc_id", timed_text.front_matter(fields).alias("head"))


def subtitle_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every ten minutes of a recording written as one file, in four formats by turns, and read back: all their cues."""
    cues = timed_text.distinct_cues(table(spark, d, "cues")).filter("seconds < 360000 and doc_id is not null")
    plain = F.regexp_replace(F.regexp_replace("text", r"<[^>]*>|&[^;]*;|[<>&\r\n,]", " "), r"-->", " ")
    stamp = F.format_string("%02d:%02d:%06.3f", F.floor(F.col("seconds") / 3600), F.floor(F.col("seconds") % 3600 / 60), F.col("seconds") % 60)
    placed = cues.select("doc_id", F.floor(F.col("seconds") / 600).alias("block"), F.struct("seconds", "seq", stamp.alias("stamp"), plain.alias("text")).alias("cue"))
    files = placed.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("cue")).alias("cues"))  # the cues of ten minutes at most

    def joined(line: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform("cues", line), "")

    vtt = F.concat(F.lit("WEBVTT\n\n"), joined(lambda c: F.concat(c["stamp"], F.lit(" --> 99:00:00.000\n"), c["text"], F.lit("\n\n"))))
    srt = F.array_join(F.transform("cues", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), F.replace(c["stamp"], F.lit("."), F.lit(",")), F.lit(" --> 99:00:00,000\n"), c["text"], F.lit("\n\n"))), "")
    events = F.transform("cues", lambda c: F.struct(F.round(c["seconds"] * 1000).cast("bigint").alias("tStartMs"), F.array(F.struct(c["text"].alias("utf8"))).alias("segs")))
    ttml = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body><div>'), joined(lambda c: F.concat(F.lit('<p begin="'), c["stamp"], F.lit('">'), c["text"], F.lit("</p>"))), F.lit("</div></body></tt>"))
    turn = (F.col("doc_id") + F.col("block")) % 4
    ext = F.when(turn == 0, "vtt").when(turn == 1, "srt").when(turn == 2, "json3").otherwise("ttml")
    payload = F.when(turn == 0, vtt).when(turn == 1, srt).when(turn == 2, F.to_json(F.struct(events.alias("events")))).otherwise(ttml)
    read, rejected = subtitles.parse_subtitles(files.select("doc_id", ext.alias("ext"), payload.alias("payload")))
    found = read.select("doc_id", F.round("seconds", 3).alias("seconds"), "text", F.lit(True).alias("read"))
    return found.unionByName(rejected.select("doc_id", F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("read")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (dedupe_consecutive, gap_merge, text_normalize, html_strip_unescape, token_normalize, clock_roundtrip, candidate_best, markdown_transcript, front_matter, subtitle_parse)
}

_CUES = "cue AS (SELECT DISTINCT doc_id, seq, seconds, text FROM cues WHERE text <> '' AND seconds IS NOT NULL)"
_S = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{85}\x{2028}\x{2029}\x0B]"
_SPACED = rf"trim(regexp_replace(text, '{_S}+', ' ', 'g'))"
_CLOCK = "CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"

SQL = {
    "dedupe_consecutive": f"WITH {_CUES} SELECT doc_id, seq FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seconds, seq) AS before FROM cue) WHERE text IS DISTINCT FROM before",
    "text_normalize": rf"WITH {_CUES} SELECT doc_id, seq, regexp_replace(regexp_replace(regexp_replace({_SPACED}, '\s+([,.;:!?])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+([)\]}}])', '\1', 'g') AS text FROM cue",
    "html_strip_unescape": rf"""WITH {_CUES} SELECT doc_id, seq, text FROM (SELECT doc_id, seq, regexp_replace(trim(regexp_replace(
  regexp_replace(replace(replace(replace(text, '&nbsp;', chr(160)), '&eacute;', 'é'), '&#39;', chr(39)), '<[^>]+>', '', 'g'), '{_S}+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS text FROM cue) WHERE true""",
    "token_normalize": rf"WITH {_CUES} SELECT regexp_replace(lower(w), '[^\pL\pM\pN_'']+', '', 'g') AS token, count(*) AS n FROM (SELECT unnest(string_split({_SPACED}, ' ')) AS w FROM cue) WHERE w <> '' GROUP BY 1",
    "clock_roundtrip": f"SELECT o_orderkey, {_CLOCK} AS clock, CAST(s AS DOUBLE) AS seconds FROM (SELECT o_orderkey, o_orderkey * 7 AS s FROM orders)",
    "candidate_best": """WITH x AS (SELECT space, doc_id AS ordinal, replace(lower(coalesce(lang, 'und')), '_', '-') AS l, string_split(replace(lower(coalesce(lang, 'und')), '_', '-'), '-')[1] AS b,
  CASE WHEN source IN ('wiki', 'readme') THEN 1000 ELSE 500 END + ([70, 65, 55, 50, 45, 40, 35])[doc_id % 7 + 1] AS base FROM documents),
 y AS (SELECT space, ordinal, base + CASE WHEN l = 'en' THEN 10 ELSE 0 END + CASE WHEN greatest(p0, p1, p2) > 0 THEN greatest(p0, p1, p2) WHEN l = 'en' THEN 220 WHEN b = 'en' THEN 180 ELSE 0 END AS score FROM
  (SELECT *, CASE WHEN l = 'de' THEN 300 WHEN b = 'de' THEN 260 ELSE 0 END AS p0, CASE WHEN l = 'pt-br' THEN 280 WHEN b = 'pt' THEN 240 ELSE 0 END AS p1, CASE WHEN l = 'fr' THEN 260 WHEN b = 'fr' THEN 220 ELSE 0 END AS p2 FROM x))
SELECT space, ordinal, CAST(score AS INT) AS score FROM y QUALIFY row_number() OVER (PARTITION BY space ORDER BY score DESC, ordinal) = 1""",
    "markdown_transcript": f"""SELECT doc_id, seq, '- [' || {_CLOCK} || '] ' || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || text AS line
FROM (SELECT DISTINCT doc_id, seq, CAST(trunc(seconds) AS BIGINT) AS s, text, speaker FROM cues WHERE text <> '')""",
    "front_matter": "SELECT doc_id, array_to_string(['---', 'source: ' || CAST(to_json(coalesce(source, '')) AS VARCHAR), 'lang: ' || CAST(to_json(coalesce(lang, '')) AS VARCHAR), 'space: ' || CAST(to_json(coalesce(space, '')) AS VARCHAR), '---'], chr(10)) AS head FROM documents",
}

# Lines of digits, of notes and of the mark of the format are no text of a cue in the formats of lines.
SQL["subtitle_parse"] = rf"""WITH {_CUES}, p AS (SELECT doc_id, seconds, floor(seconds / 600) AS block,
  regexp_replace(regexp_replace(text, '<[^>]*>|&[^;]*;|[<>&\r\n,]', ' ', 'g'), '-->', ' ', 'g') AS t FROM cue WHERE seconds < 360000 AND doc_id IS NOT NULL),
 q AS (SELECT *, regexp_replace(trim(regexp_replace(t, '{_S}+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS text FROM p)
SELECT doc_id, round(seconds, 3) AS seconds, text, true AS read FROM q WHERE text <> ''
 AND NOT ((doc_id + block) % 4 < 2 AND (regexp_full_match(text, '[0-9]+') OR text = 'WEBVTT' OR starts_with(text, 'NOTE') OR starts_with(text, 'STYLE') OR starts_with(text, 'REGION')))"""



def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace({text}, '{_S}+', ' ', 'g')), ' ')"


def _plain(text: str) -> str:
    return f"list_transform({_words(text)}, lambda w: regexp_replace(lower(w), '[^\\pL\\pN_'']+', '', 'g'))"


# The fold, one cue of every recording a step: a cue joins the one being built, or opens the next.
SQL["gap_merge"] = rf"""WITH RECURSIVE {_CUES},
 o AS (SELECT doc_id, seconds, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY seconds, seq) AS i FROM
  (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seconds, seq) AS before FROM cue) WHERE text IS DISTINCT FROM before),
 w AS (SELECT *, {_words("text")} AS own, {_plain("text")} AS plain FROM o),
 f AS (SELECT doc_id, i, i AS first, seconds, seq, text FROM o WHERE i = 1 UNION ALL
  SELECT doc_id, i, CASE WHEN joins THEN first ELSE i END, CASE WHEN joins THEN seconds ELSE more_seconds END, CASE WHEN joins THEN seq ELSE more_seq END,
   CASE WHEN joins THEN regexp_replace(trim(regexp_replace(CASE WHEN contains(text, more) THEN text ELSE text || ' ' || array_to_string(own[coalesce(list_max(
     list_filter(range(1, least(len(built), len(plain)) + 1), lambda n: built[len(built) - n + 1:len(built)] = plain[1:n])), 0) + 1:], ' ') END, '{_S}+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') ELSE more END
  FROM (SELECT f.doc_id, w.i, f.first, f.seconds, f.seq, f.text, w.seconds AS more_seconds, w.seq AS more_seq, w.text AS more, w.own, w.plain, {_plain("f.text")} AS built,
    w.seconds - f.seconds <= 3.2 AND right(f.text, 1) NOT IN ('.', '!', '?') AND len({_words("f.text")}) < 80 AS joins
   FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)),
 m AS (SELECT doc_id, first, any_value(seq) AS seq, CAST(trunc(any_value(seconds)) AS BIGINT) AS s, arg_max(text, i) AS text FROM f GROUP BY doc_id, first)
SELECT doc_id, seq, {_CLOCK} AS timestamp, text FROM m"""
