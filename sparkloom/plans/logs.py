"""Queries of log analytics over session_lines, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import logs
from sparkloom.session import table

SINCE, UNTIL = "2026-03-01", "2026-07-01"
PROJECTS = ("watcher", "edge")
MODEL = "larch"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return logs.entries(table(spark, d, "session_lines"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return logs.messages(_parsed(spark, d))


def session_headers(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessions(_parsed(spark, d))


def since_until_filter(spark: SparkSession, d: str) -> DataFrame:
    return logs.filter_sessions(logs.sessions(_parsed(spark, d)), PROJECTS, SINCE, UNTIL)


def period_bounds(spark: SparkSession, d: str) -> DataFrame:
    return logs.period_bounds(logs.sessions(_parsed(spark, d)))


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return logs.usage_totals(_messages(spark, d))


def model_filter_conditional(spark: SparkSession, d: str) -> DataFrame:
    return logs.usage_totals(_messages(spark, d), MODEL)


def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return logs.cost_by_model(_messages(spark, d))


def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return logs.cache_hit_rate(logs.usage_totals(_messages(spark, d)))


def session_totals(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    rows = logs.messages(parsed)
    return logs.session_totals(logs.sessions(parsed), rows, logs.tool_calls(rows))


def top_sessions(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_sessions(session_totals(spark, d))


def tool_call_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d)
    return logs.tool_leaderboard(rows, logs.tool_calls(rows))


def tool_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.tool_errors(_messages(spark, d))


def read_mode_by_ext(spark: SparkSession, d: str) -> DataFrame:
    return logs.reads_by_extension(logs.file_access(logs.tool_calls(_messages(spark, d))), None)


def path_suffix_counts(spark: SparkSession, d: str) -> DataFrame:
    access = logs.file_access(logs.tool_calls(_messages(spark, d)))
    return access.groupBy("extension").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def command_head_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.command_heads(logs.tool_calls(_messages(spark, d)))


def message_role_counts(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).groupBy("role").agg(F.count("*").alias("n"))


def text_block_join(spark: SparkSession, d: str) -> DataFrame:
    return logs.message_texts(_messages(spark, d)).filter("text is not null").select("path", "line_no", "text")


def conversation_last_assistant(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_assistant_texts(_messages(spark, d))


#: Measures of the sections of the report, and what names their rows.
REPORT_MEASURES = {
    "overview": ("''", ("messages", "sessions", "input", "output", "cache_read", "cache_write", "reasoning", "total", "cost", "mean_tokens", "mean_cost")),
    "models": ("model", ("tokens", "cost", "messages")),
    "cache": ("''", ("cache_read", "cache_write", "input", "output", "hit_rate")),
    "tools": ("name", ("calls", "errors", "rate")),
    "files": ("extension", ("reads", "ranged", "full", "edits", "ranged_percent")),
    "bash": ("head", ("n",)),
    "sessions": ("path", ("cost", "tokens", "calls")),
}


def log_report(spark: SparkSession, d: str) -> DataFrame:
    """All sections of the report as one table: ``section``, ``item``, ``measure`` and ``value``."""
    sections = logs.chosen_sections(logs.report(table(spark, d, "session_lines")))

    def melted(name: str, df: DataFrame) -> DataFrame:
        item, measures = REPORT_MEASURES[name]
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(name).alias("section"), F.expr(item).alias("item"), F.explode(values).alias("v")).select("section", "item", "v.measure", "v.value")

    return functools.reduce(DataFrame.unionByName, [melted(name, df) for name, df in sections])


def log_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The report as lines to read."""
    return logs.report_text(logs.report(table(spark, d, "session_lines")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        session_headers, since_until_filter, period_bounds, usage_totals, model_filter_conditional, cost_by_model, cache_hit_rate, session_totals,
        top_sessions, tool_call_leaderboard, tool_error_counts, read_mode_by_ext, path_suffix_counts, command_head_counts, message_role_counts,
        text_block_join, conversation_last_assistant, log_report, log_report_lines,
    )
}

# DuckDB reads trailing commas and NaN as JSON and keeps repeated keys; lines with such are left out first.
_BASE = r"""
WITH lines AS (
  SELECT DISTINCT path, line_no, line FROM session_lines
  WHERE line IS NOT NULL AND json_valid(line) AND NOT regexp_matches(line, ',\s*[}\]]') AND NOT regexp_matches(line, '[:\[,]\s*-?(NaN|nan|Infinity|inf)\b')),
e AS (SELECT path, line_no, line::JSON AS j, line::JSON->>'$.type' AS type FROM lines WHERE json_type(line::JSON) = 'OBJECT'),
s AS (
  SELECT path, coalesce(nullif(h.cwd, ''), CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] ELSE '' END) AS cwd,
    coalesce(h.ts, '') AS started
  FROM (SELECT path, arg_min(struct_pack(cwd := j->>'$.cwd', ts := j->>'$.timestamp'), line_no) FILTER (type = 'session') AS h FROM e GROUP BY path)),
m AS (
  SELECT path, line_no, j->>'$.message.role' AS role, coalesce(nullif(j->>'$.message.model', ''), '?') AS model,
    coalesce(nullif(j->>'$.message.toolName', ''), '?') AS tool_name, coalesce(try_cast(j->>'$.message.isError' AS BOOLEAN), false) AS is_error,
    coalesce(json_type(j, '$.message.usage') = 'OBJECT' AND j->>'$.message.usage' <> '{}', false) AS has_usage,
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.input', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS "input",
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.output', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS "output",
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.cacheRead', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS cache_read,
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.cacheWrite', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS cache_write,
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.reasoning', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS reasoning,
    coalesce(CAST(trunc(try_cast(replace(replace(j->>'$.message.usage.totalTokens', 'true', '1'), 'false', '0') AS DOUBLE)) AS BIGINT), 0) AS total,
    coalesce(try_cast(j->>'$.message.usage.cost.total' AS DECIMAL(38,10)), 0) AS cost, json_extract(j, '$.message.content') AS content
  FROM e WHERE type = 'message'),
b AS (SELECT path, line_no, pos, block FROM (
  SELECT path, line_no, unnest(CAST(content AS JSON[])) AS block, generate_subscripts(CAST(content AS JSON[]), 1) AS pos FROM m WHERE json_type(content) = 'ARRAY')),
c AS (
  SELECT path, line_no, name, CASE WHEN json_type(args) = 'OBJECT' THEN args END AS args FROM (
    SELECT path, line_no, coalesce(nullif(block->>'$.name', ''), '?') AS name,
      coalesce(CASE WHEN a::VARCHAR NOT IN ('null', '""', '{}', '[]', 'false', '0', '0.0', '-0') THEN a END, CASE WHEN i::VARCHAR NOT IN ('null', '""', '{}', '[]', 'false', '0', '0.0', '-0') THEN i END) AS args
    FROM (SELECT *, json_extract(block, '$.arguments') AS a, json_extract(block, '$.input') AS i FROM b WHERE block->>'$.type' = 'toolCall'))),
p AS (
  SELECT path, name, args, unnest(flatten([CASE WHEN json_type(args, '$.' || k) = 'VARCHAR' THEN [args->>('$.' || k)]
      WHEN json_type(args, '$.' || k) = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract(args, '$.' || k) AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END
      FOR k IN ['path', 'file', 'paths', 'files', 'filePath', 'file_path']])) AS file
  FROM c WHERE name IN ('read', 'edit', 'write') AND args IS NOT NULL),
f AS (
  SELECT path, file, coalesce(nullif(regexp_extract(file, '(?:^|/)[^/]*[^/.][^/]*?(\.[^./]+)/*$', 1), ''), '(none)') AS extension,
    CASE WHEN name <> 'read' THEN 'edit'
      WHEN coalesce(args->>'$.offset', '') NOT IN ('', '0', 'false', 'null', '0.0') OR coalesce(args->>'$.limit', '') NOT IN ('', '0', 'false', 'null', '0.0') THEN 'ranged' ELSE 'full' END AS kind
  FROM p)
"""
_TOTALS = """SELECT count(*) AS messages, count(DISTINCT path) AS sessions,
  {sums}, CAST(coalesce(sum(cost) FILTER (has_usage AND contains(model, '{model}')), 0) AS DOUBLE) AS cost FROM m"""
_SUMS = ", ".join(
    f"CAST(coalesce(sum({c}) FILTER (has_usage AND contains(model, '{{model}}')), 0) AS BIGINT) AS {c}" for c in ('"input"', '"output"', "cache_read", "cache_write", "reasoning", "total")
)
_SESSION_TOTALS = """SELECT s.path, cwd, started, coalesce(CAST(u.cost AS DOUBLE), 0) AS cost, CAST(coalesce(u.tokens, 0) AS BIGINT) AS tokens, coalesce(k.calls, 0) AS calls
FROM s LEFT JOIN (SELECT path, sum(cost) AS cost, sum(total) AS tokens FROM m WHERE has_usage GROUP BY path) u ON s.path = u.path
LEFT JOIN (SELECT path, count(*) AS calls FROM c GROUP BY path) k ON s.path = k.path"""
_TEXTS = """SELECT path, line_no, role, nullif(CASE WHEN json_type(content) = 'VARCHAR' THEN content->>'$' ELSE
  (SELECT string_agg(block->>'$.text', chr(10) || chr(10) ORDER BY pos) FROM b WHERE b.path = m.path AND b.line_no = m.line_no AND block->>'$.type' = 'text' AND block->>'$.text' IS NOT NULL) END, '') AS text FROM m"""

SQL = {
    "session_headers": _BASE + "SELECT path, cwd, started FROM s",
    "since_until_filter": _BASE
    + f"SELECT path, cwd, started FROM s WHERE (contains(cwd, '{PROJECTS[0]}') OR contains(cwd, '{PROJECTS[1]}')) AND (started = '' OR substr(started, 1, 10) >= '{SINCE}') AND (started = '' OR substr(started, 1, 10) < '{UNTIL}')",
    "period_bounds": _BASE + "SELECT min(nullif(started, '')) AS first, max(nullif(started, '')) AS last FROM s",
    "usage_totals": _BASE + _TOTALS.format(sums=_SUMS.format(model=""), model=""),
    "model_filter_conditional": _BASE + _TOTALS.format(sums=_SUMS.format(model=MODEL), model=MODEL),
    "cost_by_model": _BASE
    + """, t AS (SELECT model, sum(total) AS tokens, sum(cost) AS money, count(*) AS messages FROM m WHERE has_usage GROUP BY model),
 r AS (SELECT *, coalesce(CAST(money AS DOUBLE) / nullif(CAST(sum(money) OVER () AS DOUBLE), 0), 0) AS part FROM t)
SELECT model, CAST(tokens AS BIGINT) AS tokens, CAST(money AS DOUBLE) AS cost, messages, round(part, 6) AS share,
  repeat('#', CAST(round_even(part * 24, 0) AS INT)) || repeat('.', 24 - CAST(round_even(part * 24, 0) AS INT)) AS bar FROM r""",
    "cache_hit_rate": _BASE
    + """, t AS (SELECT CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum("input") AS BIGINT) AS "input", CAST(sum("output") AS BIGINT) AS "output" FROM m WHERE has_usage)
SELECT cache_read, cache_write, "input", "output", round(100.0 * cache_read / nullif(cache_read + "input" + cache_write, 0), 6) AS hit_rate FROM t""",
    "session_totals": _BASE + _SESSION_TOTALS,
    "top_sessions": _BASE
    + f", t AS ({_SESSION_TOTALS}) SELECT path, string_split(regexp_replace(cwd, '/+$', ''), '/')[-1] AS project, substr(started, 1, 10) AS day, cost, tokens, calls FROM t ORDER BY t.cost DESC, path LIMIT 12",
    "tool_call_leaderboard": _BASE
    + """, k AS (SELECT name, count(*) AS calls FROM c GROUP BY name), x AS (SELECT tool_name AS name, count(*) AS errors FROM m WHERE role = 'toolResult' AND is_error GROUP BY 1)
SELECT name, calls, coalesce(errors, 0) AS errors, round(100.0 * coalesce(errors, 0) / calls, 6) AS rate FROM k LEFT JOIN x USING (name) ORDER BY calls DESC, name LIMIT 12""",
    "tool_error_counts": _BASE + "SELECT tool_name AS name, count(*) AS errors FROM m WHERE role = 'toolResult' AND is_error GROUP BY 1",
    "read_mode_by_ext": _BASE
    + """SELECT extension, count(*) FILTER (kind <> 'edit') AS reads, count(*) FILTER (kind = 'ranged') AS ranged, count(*) FILTER (kind = 'full') AS "full", count(*) FILTER (kind = 'edit') AS edits,
 round(100.0 * count(*) FILTER (kind = 'ranged') / count(*) FILTER (kind <> 'edit'), 6) AS ranged_percent FROM f GROUP BY extension HAVING count(*) FILTER (kind <> 'edit') > 0""",
    "path_suffix_counts": _BASE + "SELECT extension, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY extension",
    "command_head_counts": _BASE
    + r"""SELECT CASE WHEN head = '' THEN '(empty)' ELSE regexp_extract(head, '[^/]*$') END AS head, count(*) AS n FROM (
 SELECT regexp_extract(regexp_replace(coalesce(args->>'$.command', ''), '^[\s(]+', ''), '^(\S+)', 1) AS head FROM c WHERE name = 'bash' AND args IS NOT NULL) GROUP BY 1""",
    "message_role_counts": _BASE + "SELECT role, count(*) AS n FROM m GROUP BY role",
    "text_block_join": _BASE + f"SELECT path, line_no, text FROM ({_TEXTS}) WHERE text IS NOT NULL",
    "conversation_last_assistant": _BASE + f"SELECT path, max(line_no) AS line_no, arg_max(text, line_no) AS text FROM ({_TEXTS}) WHERE role = 'assistant' AND text IS NOT NULL GROUP BY path",
}


def _melted(section: str, query: str) -> str:
    item, measures = REPORT_MEASURES[section]
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f'CAST("{m}" AS DOUBLE)' for m in measures)
    return f"SELECT '{section}' AS section, {item} AS item, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({query})"


_FILES_OF_LINES = "(SELECT count(DISTINCT path) FROM session_lines)"
SQL["log_report"] = "\nUNION ALL ".join(
    [
        _melted("overview", f"SELECT * REPLACE (n AS sessions), floor(total / n) AS mean_tokens, round(cost / n, 3) AS mean_cost FROM ({SQL['usage_totals']}), (SELECT {_FILES_OF_LINES} AS n)"),
        _melted("models", f"SELECT * FROM ({SQL['cost_by_model']}) ORDER BY cost DESC, model LIMIT 12"),
        _melted("cache", SQL["cache_hit_rate"]),
        _melted("tools", SQL["tool_call_leaderboard"]),
        _melted("files", f"SELECT * FROM ({SQL['read_mode_by_ext']}) ORDER BY reads DESC, extension LIMIT 12"),
        _melted("bash", f"SELECT * FROM ({SQL['command_head_counts']}) ORDER BY n DESC, head LIMIT 12"),
        _melted("sessions", SQL["top_sessions"]),
    ]
)
