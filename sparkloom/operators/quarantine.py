"""Loading rows and setting apart those that fail, each with its reasons.

Every column is loaded as nullable text. Rules are Boolean columns over these texts (casts and
constraints, true where the row breaks them); a row's broken rules form its array ``errors``. Rows
with an empty array are sound, the others are kept whole beside their errors. All of it is one narrow
pass of column expressions; only the RFC 8259 test of a JSON line, for which Spark has no strict
parser, is an Arrow-batched UDF that hands back nullable text.

Defined cases: null lines and lines of white space only are neither sound nor failing; very long
lines are read whole, JSON of any depth too; columns besides ``path``, ``line_no`` and ``line`` are dropped; rows delivered
again (equal ``path``, ``line_no`` and ``line``) count once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.json_text import BROKEN, parse_strict, token, token_start
from sparkloom.functions.skew import block_join

#: Entry types of a session log (fixed values).
ENTRY_TYPES = ("session", "message", "model_change", "compaction", "custom")
#: Token counts of a message's usage (fixed values).
USAGE_COUNTS = ("input", "output", "cacheRead", "cacheWrite", "reasoning", "totalTokens")
#: Columns of an export, in order (fixed values).
EXPORT_COLUMNS = ("entry_id", "type", "timestamp", "role", "message")

LINE_KEY = ("path", "line_no")

Rules = Sequence[tuple[str, Column]]


def errors_of(rules: Rules) -> Column:
    """Array of the names of all broken rules, in the order of the rules. A rule that is null holds."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda e: e.isNotNull())


def with_errors(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with their array ``errors``."""
    return rows.withColumn("errors", errors_of(rules))


def split_rows(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Sound rows without, and failing rows with ``errors``."""
    checked = with_errors(rows, rules)
    sound = F.size("errors") == 0
    return checked.filter(sound).drop("errors"), checked.filter(~sound)


def not_blank(line: Column) -> Column:
    """The line has something other than white space."""
    return line.rlike(r"(?U)\S")


# --- JSON lines --------------------------------------------------------------------------------

#: Text columns of a session line: name and path into the entry.
SESSION_TEXTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("entry", ()),
    ("type", ("type",)),
    ("timestamp", ("timestamp",)),
    ("cwd", ("cwd",)),
    ("message", ("message",)),
    ("role", ("message", "role")),
    ("model", ("message", "model")),
    ("tool_name", ("message", "toolName")),
    ("content", ("message", "content")),
    ("is_error", ("message", "isError")),
    ("usage", ("message", "usage")),
    *((f"usage_{name}", ("message", "usage", name)) for name in USAGE_COUNTS),
    ("cost", ("message", "usage", "cost")),
    ("cost_total", ("message", "usage", "cost", "total")),
)


#: Texts of which only the kind is told: ``"`` for a string, else as :func:`sparkloom.functions.json_text.token`.
KIND_ONLY = frozenset({"entry", "message", "content", "usage", "cost"})


def texts_of(value: object, texts: Iterable[tuple[str, tuple[str, ...]]]) -> Iterator[str | None]:
    """The nullable texts of a parsed line, one per path into it."""
    for name, path in texts:
        at, there = value, value is not BROKEN
        for key in path:
            there = there and isinstance(at, dict) and key in at
            if not there:
                break
            at = at[key]
        if not there:
            yield None
        elif name in KIND_ONLY and isinstance(at, str):
            yield token_start(at)
        else:
            yield token(at)


def json_texts(line: Column, texts: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """Struct of nullable texts, one per path into the JSON value of a line; all null if it is not JSON.

    A text is the value's JSON token (see :func:`texts_of`), null where absent.
    """
    texts = tuple(texts)
    fields = T.StructType([T.StructField(name, T.StringType()) for name, _ in texts])

    @F.arrow_udf(fields)
    def read(batch: pa.Array) -> pa.Array:
        columns: list[list[str | None]] = [[] for _ in texts]
        for text in batch.to_pylist():
            value = BROKEN if text is None else parse_strict(text)
            for column, x in zip(columns, texts_of(value, texts)):
                column.append(x)
        arrays = [pa.array(c, pa.string()) for c in columns]
        return pa.StructArray.from_arrays(arrays, [name for name, _ in texts])

    return read.asNondeterministic()(line)  # so that no filter on the texts reads the line again


def session_texts(lines: DataFrame) -> DataFrame:
    """Distinct session lines that are not blank, with struct ``e`` of their nullable texts."""
    kept = lines.select(*LINE_KEY, "line").filter(not_blank(F.col("line")))
    return kept.withColumn("e", json_texts(F.col("line"), SESSION_TEXTS))


def _is(text: Column, start: str) -> Column:
    return F.coalesce(text.startswith(start), F.lit(False))


def _absent(text: Column) -> Column:
    return text.isNull() | (text == "null")


def session_rules(e: str = "e") -> Rules:
    """Rules of a session entry over the texts of :func:`session_texts`."""

    def t(name: str) -> Column:
        return F.col(f"{e}.{name}")

    known = F.coalesce(t("type").isin(*(f'"{name}' for name in ENTRY_TYPES)), F.lit(False))
    counts_hold = [_absent(t(f"usage_{n}")) | t(f"usage_{n}").rlike(r"^(?:[0-9]+|-0)$") for n in USAGE_COUNTS]
    total = t("cost_total")
    total_holds = _absent(total) | (total.rlike("^[-0-9]") & (total.try_cast("double") >= 0))
    usage_holds = _absent(t("usage")) | (
        _is(t("usage"), "{")
        & F.forall(F.array(*counts_hold), lambda c: c)
        & (_absent(t("cost")) | (_is(t("cost"), "{") & total_holds))
    )
    message_holds = (
        _is(t("message"), "{")
        & _is(t("role"), '"')
        & (_absent(t("content")) | _is(t("content"), '"') | t("content").rlike(r'^\[["{]*$'))
        & (_absent(t("is_error")) | t("is_error").isin("true", "false"))
        & usage_holds
    )
    syntax, shape = t("entry").isNull(), ~_is(t("entry"), "{")
    return [
        ("syntax", syntax),
        ("shape", ~syntax & shape),
        ("value", ~syntax & ~shape & (~known | ((t("type") == '"message') & ~F.coalesce(message_holds, F.lit(False))))),
    ]


def check_session_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines with texts ``e`` and ``errors`` (delivered-again rows are still there)."""
    return with_errors(session_texts(lines), session_rules())


def _string(name: str) -> Column:
    """Value of a string text; null for another kind."""
    return F.when(_is(F.col(f"e.{name}"), '"'), F.substr(F.col(f"e.{name}"), F.lit(2))).alias(name)


def session_entries(lines: DataFrame) -> DataFrame:
    """Sound session entries, typed: strings, counts (decimal(38,0)), cost (double) and ``is_error``."""
    sound = check_session_lines(lines).filter(F.size("errors") == 0).dropDuplicates(["path", "line_no", "line"])
    return sound.select(
        *LINE_KEY,
        *[_string(n) for n in ("type", "timestamp", "cwd", "role", "model", "tool_name")],
        F.col("e.is_error").try_cast("boolean").alias("is_error"),
        *[F.col(f"e.usage_{n}").try_cast("decimal(38,0)").alias(f"usage_{n}") for n in USAGE_COUNTS],
        F.col("e.cost_total").try_cast("double").alias("cost_total"),
        "line",
    )


# --- delimited exports -------------------------------------------------------------------------


def export_delimiters(lines: DataFrame) -> DataFrame:
    """``path`` and ``delimiter`` of each export whose first line is a header, with its ``last_line``."""
    names = "(.)".join(f'"?{c}"?' for c in EXPORT_COLUMNS)
    found = F.regexp_extract(F.regexp_replace("line", "[\r\n]+$", ""), f"^{names}$", 1)
    header = F.when(F.col("line_no") == 1, found)
    return lines.groupBy("path").agg(F.max(header).alias("delimiter"), F.max("line_no").alias("last_line")).filter(F.col("delimiter") != "")


def export_texts(lines: DataFrame) -> DataFrame:
    """Lines of exports with ``fields`` (array of texts) and what shows of their quoting.

    A line is split at its quotes: segments of even number lie outside quoted fields, and an empty one
    between two others is a doubled quote. Blank lines and headers are left out; the delimiter of a file
    without a header is a comma.
    """
    own = lines.select(*LINE_KEY, F.regexp_replace("line", "[\r\n]+$", "").alias("text"), "line").filter(not_blank(F.col("line")))
    joined = block_join(own, export_delimiters(lines), ["path"], F.col("line_no"), "last_line")
    rows = joined.filter((F.col("line_no") != 1) | F.col("delimiter").isNull()).withColumn("d", F.coalesce("delimiter", F.lit(",")))
    d, nul = F.col("d"), F.lit("\0")

    def marked(part: Column, i: Column) -> Column:
        """Inner text as it is, delimiters outside as NUL, empty outer segments as a quote."""
        clean = F.replace(part, nul, F.lit("\ufffd"))
        return F.when(i % 2 == 1, clean).when(part == "", F.lit('"')).otherwise(F.replace(clean, d, nul))

    # Segments are only looked at one by one, never from within each other, so long lines take linear time.
    parts = rows.withColumn("parts", F.split("text", '"', -1))
    outer = parts.withColumn("outer", F.filter("parts", lambda p, i: i % 2 == 0))
    first, last = F.get("outer", F.lit(0)), F.element_at("outer", -1)
    single = F.size("parts") == 1
    between = F.slice("outer", F.lit(2), F.greatest(F.size("outer") - 2, F.lit(0)))
    well = (
        (F.size("parts") % 2 == 1)
        & (single | (((first == "") | first.endswith(d)) & ((last == "") | last.startswith(d))))
        & F.forall(between, lambda p: (p == "") | (p.startswith(d) & p.endswith(d)))
    )
    text = F.array_join(F.transform("parts", marked), "")
    start = F.when(~single & (first == ""), 2).otherwise(1)
    size = F.length(text) - (start - 1) - F.when(~single & (last == ""), 1).otherwise(0)
    joined = F.when(single, F.replace(F.replace("text", nul, F.lit("\ufffd")), d, nul)).otherwise(F.substr(text, start, size))
    return outer.select(*LINE_KEY, "line", well.alias("quoted_well"), F.split(joined, "\0", -1).alias("fields"))


def is_iso_instant(text: Column) -> Column:
    """The text is a real ISO 8601 date and time with zone."""
    form = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)$"
    return text.rlike(form) & F.substr(text, F.lit(1), F.lit(10)).try_cast("date").isNotNull()


def export_rules() -> Rules:
    """Rules of an export line over the columns of :func:`export_texts`."""

    def f(i: int) -> Column:
        return F.get("fields", F.lit(i))

    quoting = ~F.col("quoted_well")
    count = F.size("fields") != len(EXPORT_COLUMNS)
    value = ~(f(0).rlike("^[0-9]+$") & f(1).isin(*ENTRY_TYPES) & ((f(2) == "") | is_iso_instant(f(2))))
    return [("quoting", quoting), ("column_count", ~quoting & count), ("value", ~quoting & ~count & value)]


def export_entries(lines: DataFrame) -> DataFrame:
    """Sound entries of exports: the five columns as text, an empty field as null."""
    sound, _ = split_rows(export_texts(lines), export_rules())
    texts = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(EXPORT_COLUMNS)]
    return sound.select(*LINE_KEY, *texts).distinct()


def failing_lines(session_lines: DataFrame, export_lines: DataFrame) -> DataFrame:
    """``path``, ``line_no`` and ``reason`` (the first that holds) of every failing line of both tables."""
    sessions = check_session_lines(session_lines)
    _, exports = split_rows(export_texts(export_lines), export_rules())
    failing = sessions.filter(F.size("errors") > 0).select(*LINE_KEY, "errors").unionByName(exports.select(*LINE_KEY, "errors"))
    return failing.select(*LINE_KEY, F.get("errors", F.lit(0)).alias("reason")).distinct()
