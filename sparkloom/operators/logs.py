"""Analytics over session logs: JSON lines of polymorphic, nested entries, one session per file.

Lines (``path``, ``line_no``, ``line``) are parsed once into VARIANT and projected to a typed layer of
messages; tool calls are exploded from it. Filters on sessions join the small table of sessions, so
that they apply before any aggregation; all aggregates are partial before their shuffle.

Defined cases: blank lines, lines that are no JSON and JSON other than objects are skipped; of a repeated
key in an object the last value counts; a line delivered again counts once; null counts are 0; a
missing model, tool or name is ``?``. Ties are broken by the key in ascending order.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.constants import BAR_WIDTH, PATH_KEYS, REPORT_SECTIONS, TOP_ROWS
from sparkloom.functions.paths import base_name, command_head, parent_name, suffix
from sparkloom.functions.variants import last_of_repeated_keys, objects_of
from sparkloom.session import stored

MONEY = "decimal(38,10)"
COUNTS = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "reasoning": "reasoning", "total": "totalTokens"}


def entries(lines: DataFrame) -> DataFrame:
    """Entries (JSON objects) as VARIANT ``v`` with ``path``, ``line_no``, ``line_hash``, ``type``, ``timestamp`` and
    ``cwd``. Lines delivered again are still there; they are left out behind the projections, so that no
    whole line is shuffled."""
    last_of_repeated_keys(lines.sparkSession)
    parsed = lines.select("path", "line_no", F.xxhash64("line").alias("line_hash"), objects_of(F.col("line")).alias("v"))
    return parsed.select("path", "line_no", "line_hash", "v", *[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("type", "timestamp", "cwd")])


def sessions(parsed: DataFrame) -> DataFrame:
    """One row per file: ``path``, ``cwd`` (else the name of the directory) and ``started`` (else '')."""
    head = F.min_by(F.struct("cwd", "timestamp"), F.when(F.col("type") == "session", F.col("line_no")))
    return parsed.groupBy("path").agg(head.alias("head")).select(
        "path", F.coalesce(F.nullif("head.cwd", F.lit("")), parent_name(F.col("path"))).alias("cwd"), F.coalesce("head.timestamp", F.lit("")).alias("started")
    )


def filter_sessions(table: DataFrame, projects: tuple[str, ...] = (), since: str = "", until: str = "") -> DataFrame:
    """Sessions whose ``cwd`` contains any of ``projects``, started on or after ``since`` and before
    ``until`` (dates as text). Sessions without a start pass both dates."""
    if projects:
        table = table.filter(functools.reduce(operator.or_, [F.col("cwd").contains(p) for p in projects]))
    day = F.substr("started", F.lit(1), F.lit(10))
    if since:
        table = table.filter((F.col("started") == "") | (day >= since))
    if until:
        table = table.filter((F.col("started") == "") | (day < until))
    return table


def messages(parsed: DataFrame) -> DataFrame:
    """Entries of type message with role, model, tool, error flag, usage counts, cost and ``content``."""

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("v", f"$.message.{path}", kind)

    counts = [F.coalesce(get(f"usage.{key}", "bigint"), F.lit(0)).alias(name) for name, key in COUNTS.items()]
    rows = parsed.filter(F.col("type") == "message").select(
        "path",
        "line_no",
        "line_hash",
        get("role", "string").alias("role"),
        F.coalesce(F.nullif(get("model", "string"), F.lit("")), F.lit("?")).alias("model"),
        F.coalesce(F.nullif(get("toolName", "string"), F.lit("")), F.lit("?")).alias("tool_name"),
        F.coalesce(get("isError", "boolean"), F.lit(False)).alias("is_error"),
        F.coalesce(F.schema_of_variant(get("usage", "variant")).startswith("OBJECT<"), F.lit(False)).alias("has_usage"),
        *counts,
        F.coalesce(get("usage.cost.total", MONEY), F.lit(0).cast(MONEY)).alias("cost"),
        get("content", "variant").alias("content"),
    )
    # columns that no one asks for are not kept by the aggregate either
    return rows.dropDuplicates(["path", "line_no", "line_hash"]).drop("line_hash")


def in_sessions(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the sessions kept."""
    return rows.join(kept.select("path"), "path", "left_semi")


def tool_calls(rows: DataFrame) -> DataFrame:
    """Tool calls of messages: ``path``, ``line_no``, ``name`` and ``args`` (VARIANT object, null if the
    arguments are none)."""
    block = F.explode(F.try_variant_get("content", "$", "array<variant>")).alias("block")
    calls = rows.select("path", "line_no", block).filter(F.try_variant_get("block", "$.type", "string") == "toolCall")

    def filled(key: str) -> Column:
        value = F.try_variant_get("block", f"$.{key}", "variant")
        return F.when(_filled(value), value)

    args = F.coalesce(filled("arguments"), filled("input"))
    return calls.select(
        "path",
        "line_no",
        F.coalesce(F.nullif(F.try_variant_get("block", "$.name", "string"), F.lit("")), F.lit("?")).alias("name"),
        F.when(F.schema_of_variant(args).startswith("OBJECT"), args).alias("args"),
    )


def argument_paths(args: Column) -> Column:
    """All paths that a call's arguments name, by whatever key, as text or lists of texts."""

    def of(key: str) -> Column:
        value = F.try_variant_get(args, f"$.{key}", "variant")
        one = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
        texts = F.transform(
            F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")
        )
        return F.coalesce(one, texts, F.array().cast("array<string>"))

    return F.concat(*map(of, PATH_KEYS))


def _filled(value: Column) -> Column:
    """The value is there and neither null, false, zero, an empty text, an empty list nor an empty object."""
    kind = F.schema_of_variant(value)
    nothing = (
        kind.isin("VOID", "OBJECT<>")
        | (kind.startswith("ARRAY") & (F.to_json(value) == "[]"))
        | ((kind == "STRING") & (F.try_variant_get(value, "$", "string") == ""))
        | ((kind == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"))
        | (F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False)) & (F.try_variant_get(value, "$", "double") == 0))
    )
    return value.isNotNull() & ~F.coalesce(nothing, F.lit(False))


def _truthy(args: Column, key: str) -> Column:
    return _filled(F.try_variant_get(args, f"$.{key}", "variant"))


def bar(share: Column, width: int = BAR_WIDTH) -> Column:
    """Bar of ``#`` and ``.`` for a share, halves rounded to even."""
    filled = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))


def usage_totals(rows: DataFrame, model: str = "") -> DataFrame:
    """Messages and sessions in all, and the sums of counts and cost over models that contain ``model``
    (which restricts nothing else)."""
    counted = F.col("has_usage") & F.col("model").contains(model)
    sums = [F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c) for c in COUNTS]
    return rows.agg(F.count("*").alias("messages"), F.count_distinct("path").alias("sessions"), *sums, F.coalesce(F.sum(F.when(counted, F.col("cost"))), F.lit(0)).cast("double").alias("cost"))


def cost_by_model(rows: DataFrame) -> DataFrame:
    """Tokens, cost, messages, share of the cost and its bar by model."""
    by_model = rows.filter("has_usage").groupBy("model").agg(F.sum("total").alias("tokens"), F.sum("cost").alias("money"), F.count("*").alias("messages"))
    whole = by_model.agg(F.sum("money").alias("whole"))
    share = F.coalesce(F.try_divide(F.col("money").cast("double"), F.col("whole").cast("double")), F.lit(0.0))
    return by_model.join(F.broadcast(whole)).select(
        "model", "tokens", F.col("money").cast("double").alias("cost"), "messages", F.round(share, 6).alias("share"), bar(share).alias("bar")
    )


def cache_hit_rate(totals: DataFrame) -> DataFrame:
    """Percent of prompt tokens served from the cache, of :func:`usage_totals`."""
    asked = F.col("cache_read") + F.col("input") + F.col("cache_write")
    return totals.select("cache_read", "cache_write", "input", "output", F.round(F.try_divide(F.lit(100.0) * F.col("cache_read"), asked), 6).alias("hit_rate"))


def session_totals(kept: DataFrame, rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Cost, tokens and calls of every session, also of those without usage."""
    usage = rows.filter("has_usage").groupBy("path").agg(F.sum("cost").alias("cost"), F.sum("total").alias("tokens"))
    counts = calls.groupBy("path").agg(F.count("*").alias("calls"))
    joined = kept.join(usage, "path", "left").join(counts, "path", "left")
    return joined.select(
        "path", "cwd", "started", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("calls", F.lit(0)).alias("calls")
    )


def top_sessions(totals: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """The dearest sessions with the name of their directory."""
    return totals.orderBy(F.desc("cost"), "path").limit(n).select("path", base_name(F.col("cwd")).alias("project"), F.substr("started", F.lit(1), F.lit(10)).alias("day"), "cost", "tokens", "calls")


def tool_errors(rows: DataFrame) -> DataFrame:
    """Failed tool results by tool."""
    return rows.filter((F.col("role") == "toolResult") & F.col("is_error")).groupBy(F.col("tool_name").alias("name")).agg(F.count("*").alias("errors"))


def tool_leaderboard(rows: DataFrame, calls: DataFrame, n: int | None = TOP_ROWS) -> DataFrame:
    """Calls, errors and error rate in percent of the tools called most; tools that only fail are left out."""
    board = calls.groupBy("name").agg(F.count("*").alias("calls")).join(tool_errors(rows), "name", "left")
    rated = board.select("name", "calls", F.coalesce("errors", F.lit(0)).alias("errors"), F.round(100.0 * F.coalesce("errors", F.lit(0)) / F.col("calls"), 6).alias("rate"))
    return rated.orderBy(F.desc("calls"), "name").limit(n) if n else rated


def file_access(calls: DataFrame) -> DataFrame:
    """Path by path: ``extension`` and whether it is a ``ranged`` read, a full read or an edit."""
    ranged = _truthy(F.col("args"), "offset") | _truthy(F.col("args"), "limit")
    kind = F.when(F.col("name") == "read", F.when(ranged, "ranged").otherwise("full")).otherwise("edit")
    rows = calls.filter(F.col("name").isin("read", "edit", "write") & F.col("args").isNotNull())
    return rows.select("path", kind.alias("kind"), F.explode(argument_paths(F.col("args"))).alias("file")).select("path", "kind", "file", suffix(F.col("file")).alias("extension"))


def reads_by_extension(access: DataFrame, n: int | None = TOP_ROWS) -> DataFrame:
    """Reads, ranged and full, and edits by extension; extensions that are only edited are left out."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    table = access.groupBy("extension").agg((count("ranged") + count("full")).alias("reads"), count("ranged").alias("ranged"), count("full").alias("full"), count("edit").alias("edits"))
    rated = table.filter("reads > 0").withColumn("ranged_percent", F.round(100.0 * F.col("ranged") / F.col("reads"), 6))
    return rated.orderBy(F.desc("reads"), "extension").limit(n) if n else rated


def command_heads(calls: DataFrame) -> DataFrame:
    """Calls of the shell by program."""
    head = command_head(F.try_variant_get("args", "$.command", "string"))
    return calls.filter((F.col("name") == "bash") & F.col("args").isNotNull()).groupBy(head.alias("head")).agg(F.count("*").alias("n"))


def period_bounds(kept: DataFrame) -> DataFrame:
    """First and last start of a session, as text."""
    started = F.nullif("started", F.lit(""))
    return kept.agg(F.min(started).alias("first"), F.max(started).alias("last"))


def message_texts(rows: DataFrame) -> DataFrame:
    """Texts of messages: the text blocks joined by blank lines, or the content if it is a text."""
    blocks = F.filter(F.try_variant_get("content", "$", "array<variant>"), lambda b: (F.try_variant_get(b, "$.type", "string") == "text") & F.try_variant_get(b, "$.text", "string").isNotNull())
    joined = F.array_join(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), "\n\n")
    text = F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get("content", "$", "string")).otherwise(joined)
    return rows.select("path", "line_no", "role", F.nullif(text, F.lit("")).alias("text"))


def last_assistant_texts(rows: DataFrame) -> DataFrame:
    """The last assistant message of each session that has text."""
    texts = message_texts(rows.filter(F.col("role") == "assistant")).filter(F.col("text").isNotNull())
    return texts.groupBy("path").agg(F.max("line_no").alias("line_no"), F.max_by("text", "line_no").alias("text"))


def entries_of_files(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Headers of sessions in ``parsed``, and a row of nulls for every file, as a file without a header is a
    session too."""
    columns = ["path", "line_no", "type", "timestamp", "cwd"]
    files = lines.select("path").distinct()
    return parsed.filter(F.col("type") == "session").select(*columns).unionByName(files, allowMissingColumns=True)


def per_session(overview: DataFrame) -> DataFrame:
    """With the means per session: ``mean_tokens`` (whole) and ``mean_cost``."""
    some = F.nullif("sessions", F.lit(0))
    return overview.withColumns({"mean_tokens": F.floor(F.col("total") / some), "mean_cost": F.round(F.col("cost") / some, 3)})


def report(lines: DataFrame, projects: tuple[str, ...] = (), since: str = "", until: str = "", model: str = "", top: int = TOP_ROWS) -> dict[str, DataFrame]:
    """All sections of the log report, one table each."""
    parsed = stored(entries(lines).filter(F.col("type").isin("session", "message")))
    kept = stored(filter_sessions(sessions(entries_of_files(lines, parsed)), projects, since, until))
    rows = in_sessions(messages(parsed), kept)
    priced = rows.withColumn("has_usage", F.col("has_usage") & F.col("model").contains(model))
    calls = tool_calls(rows)
    totals = usage_totals(priced)
    return {
        "overview": per_session(totals.drop("sessions").join(F.broadcast(period_bounds(kept))).join(F.broadcast(kept.agg(F.count("*").alias("sessions"))))),
        "models": cost_by_model(priced).orderBy(F.desc("cost"), "model").limit(top),
        "cache": cache_hit_rate(totals),
        "tools": tool_leaderboard(rows, calls, top),
        "files": reads_by_extension(file_access(calls), top),
        "bash": command_heads(calls).orderBy(F.desc("n"), "head").limit(top),
        "sessions": top_sessions(session_totals(kept, priced, calls), top),
    }


def chosen_sections(sections: dict[str, DataFrame], only: tuple[str, ...] = ()) -> list[tuple[str, DataFrame]]:
    """The sections asked for, in the order of the report; names that there are none of are left out."""
    return [(name, sections[name]) for name in REPORT_SECTIONS if name in sections and (not only or name in only)]


def report_json(sections: dict[str, DataFrame], only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the chosen sections as ``section`` and ``record`` (JSON)."""
    chosen = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record")) for name, df in chosen_sections(sections, only)]
    return functools.reduce(DataFrame.unionByName, chosen)


def _money(value: Column, digits: int, width: int = 0) -> Column:
    return F.format_string(f"%,{width or ''}.{digits}f", value)


def report_text(sections: dict[str, DataFrame], only: tuple[str, ...] = ()) -> DataFrame:
    """The report for reading: ``section``, ``line_no`` and ``line``. A section of no rows has no lines."""
    count = lambda name: F.format_string("%,d", F.col(name).cast("bigint"))
    forms = {
        "overview": [
            F.concat(F.lit("sessions "), count("sessions"), F.lit(", messages "), count("messages")),
            F.concat(F.lit("period "), F.substr("first", F.lit(1), F.lit(10)), F.lit(" .. "), F.substr("last", F.lit(1), F.lit(10))),
            F.concat(F.lit("tokens "), count("total"), F.lit(", cost $"), _money(F.col("cost"), 2)),
            F.concat(F.lit("per session "), count("mean_tokens"), F.lit(" tokens, $"), _money(F.col("mean_cost"), 3)),
        ],
        "models": [F.concat("bar", F.lit(" $"), _money(F.col("cost"), 2), F.lit(" "), count("tokens"), F.lit(" tokens "), "model")],
        "cache": [
            F.concat(F.lit("read "), count("cache_read"), F.lit(", written "), count("cache_write"), F.lit(", input "), count("input"), F.lit(", output "), count("output")),
            F.format_string("hit rate %.1f%%", "hit_rate"),
        ],
        "tools": [F.concat("name", F.lit(" "), count("calls"), F.lit(" calls, "), count("errors"), F.lit(" errors, "), F.format_string("%.1f%%", "rate"))],
        "files": [F.concat("extension", F.lit(" "), count("reads"), F.lit(" reads, "), count("ranged"), F.lit(" ranged, "), count("full"), F.lit(" full, "), count("edits"), F.lit(" edits, "), F.format_string("%.0f%% ranged", "ranged_percent"))],
        "bash": [F.concat(count("n"), F.lit(" "), "head")],
        "sessions": [F.concat(F.lit("$"), _money(F.col("cost"), 3), F.lit(" "), count("tokens"), F.lit(" tokens, "), count("calls"), F.lit(" calls "), "day", F.lit(" "), "project")],
    }
    order = {"models": [F.desc("cost"), "model"], "tools": [F.desc("calls"), "name"], "files": [F.desc("reads"), "extension"], "bash": [F.desc("n"), "head"], "sessions": [F.desc("cost"), "path"]}

    def lines_of(name: str, df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order[name])) if name in order else F.lit(1)  # a section is a short report
        lines = df.select(rank.alias("rank"), F.posexplode(F.array(*forms[name])).alias("i", "line"))
        return lines.filter("line is not null").select(F.lit(name).alias("section"), (F.col("rank") + F.col("i")).cast("int").alias("line_no"), "line")

    return functools.reduce(DataFrame.unionByName, [lines_of(name, df) for name, df in chosen_sections(sections, only)])
