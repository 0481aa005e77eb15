"""Queries of knowledge pages over documents, and of small records, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as text_functions
from sparkloom.operators import logs, pages, records
from sparkloom.plans.logs import _BASE
from sparkloom.plans.timed_text import _S
from sparkloom.session import table

#: Programs that the session logs use and what to take instead.
AVOIDED = {"cat": "read", "ls": "tree"}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.pages(table(spark, d, "documents"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(_pages(spark, d)).select("doc_id", "target")


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.broken_links(_pages(spark, d))


def mentioned_missing(spark: SparkSession, d: str) -> DataFrame:
    return pages.mentioned_missing(_pages(spark, d), 2)


def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.orphans(_pages(spark, d))


def index_drift(spark: SparkSession, d: str) -> DataFrame:
    return pages.index_drift(_pages(spark, d))


def thin_oversized(spark: SparkSession, d: str) -> DataFrame:
    return pages.sizes(_pages(spark, d))


def format_issues(spark: SparkSession, d: str) -> DataFrame:
    return pages.format_issues(_pages(spark, d))


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return pages.log_entries(_pages(spark, d))


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.tag_counts(_pages(spark, d))


def duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    return pages.duplicate_texts(table(spark, d, "documents"))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    calls = logs.tool_calls(logs.messages(logs.entries(table(spark, d, "session_lines"))))
    command = F.try_variant_get("args", "$.command", "string")
    return calls.filter("name = 'bash'").select("path", "line_no", command.alias("command")).filter("command is not null")


def discouraged_commands(spark: SparkSession, d: str) -> DataFrame:
    used = records.discouraged(records.shell_programs(F.col("command")), AVOIDED)
    rows = _commands(spark, d).select(used.alias("used")).filter(F.size("used") > 0)
    return rows.groupBy(records.warning(F.col("used"), AVOIDED).alias("warning")).agg(F.count("*").alias("n"))


def command_swap(spark: SparkSession, d: str) -> DataFrame:
    return _commands(spark, d).select("path", "line_no", records.swapped_commands(F.col("command"), AVOIDED).alias("command"))


def question_labels(spark: SparkSession, d: str) -> DataFrame:
    return records.questions(logs.tool_calls(logs.messages(logs.entries(table(spark, d, "session_lines")))))


def visible_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.messages(logs.entries(table(spark, d, "session_lines")))
    names = F.transform(F.filter(F.try_variant_get("content", "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "toolCall"), lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("")))
    shown = F.array_except(records.clean_list(names), F.array(F.lit("grep")))
    return rows.select("path", "line_no", F.array_join(shown, ", ").alias("tools")).filter("tools <> ''")


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "P1").when(F.col("o_orderstatus") == "O", "P2").otherwise("P3")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("axis"), severity.alias("severity"), (F.col("o_orderkey") % 101).alias("score"))
    return records.gated_findings(rows).groupBy("axis").agg(F.count("*").alias("kept"), F.sum("score").alias("score"))


def filter_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    conditions = [F.col("o_totalprice").between(100000, 200000), F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")]
    found = records.relaxed(table(spark, d, "orders"), conditions, [F.desc("o_totalprice"), "o_orderkey"], 5)
    return found.select("o_orderkey", text_functions.abbreviated(F.floor("o_totalprice")).alias("price"))


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    named = [("union", customers.union(suppliers).distinct()), ("both", customers.intersect(suppliers)), ("only customers", customers.exceptAll(suppliers).distinct().join(suppliers, "nation", "left_anti"))]
    parts = [df.select(F.lit(name).alias("set"), "nation") for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    filled = text_functions.filled_template(F.lit("Source: {{source}}\n\n{{lang}}\n\nSpace: {{space}} {{space}}"), {n: F.col(n) for n in ("source", "lang", "space")})
    return table(spark, d, "documents").select("doc_id", filled.alias("prompt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        page_links, broken_links, mentioned_missing, orphan_pages, index_drift, thin_oversized, format_issues, log_entries, tag_counts, duplicate_docs,
        discouraged_commands, command_swap, question_labels, visible_tools, confidence_gate, filter_sort_limit, set_ops, prompt_template,
    )
}

_PAGES = r"""WITH d AS (SELECT doc_id, path, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '^\x{FEFF}', '') AS body FROM documents),
f AS (SELECT *, regexp_extract(body, '^---\n((?:[^\n]*\n)*?)---(?:\n|$)', 1) AS matter, regexp_replace(regexp_extract(body, '(?m)^# +([^\n]+)$', 1), '@E', '', 'g') AS heading FROM d),
pages AS (SELECT doc_id, lower(CASE WHEN heading <> '' THEN heading ELSE regexp_replace(regexp_extract(coalesce(path, ''), '[^/]*$'), '\.[^.]+$', '') END) AS name,
  nullif(regexp_replace(regexp_extract(matter, '(?m)^type:([^\n]*)$', 1), '@E', '', 'g'), '') AS type, regexp_extract(matter, '(?m)^title:([^\n]*)$', 1) AS title,
  list_filter(list_transform(string_split(regexp_replace(regexp_extract(matter, '(?m)^tags:([^\n]*)$', 1), '[\[\]]', '', 'g'), ','), lambda t: regexp_replace(t, '@E', '', 'g')), lambda t: t <> '') AS tags,
  CAST(len(list_filter(regexp_split_to_array(body, '[ \t\n\f\r]+'), lambda w: w <> '')) AS INT) AS words, body FROM f),
links AS (SELECT doc_id, name, lower(regexp_replace(t, '@E', '', 'g')) AS target FROM (SELECT doc_id, name, unnest(regexp_extract_all(body, '\[\[([^\[\]|#\n]+)(?:[|#][^\]\n]*)?\]\]', 1)) AS t FROM pages) WHERE regexp_replace(t, '@E', '', 'g') <> ''),
names AS (SELECT DISTINCT name FROM pages WHERE name <> '') """.replace("@E", f"^{_S}+|{_S}+$")
_BROKEN = "SELECT target, count(DISTINCT doc_id) AS pages FROM links WHERE target NOT IN (SELECT name FROM names) GROUP BY target"
_COMMANDS = "SELECT path, line_no, args->>'$.command' AS command FROM c WHERE name = 'bash' AND args->>'$.command' IS NOT NULL"

SQL = {
    "page_links": _PAGES + "SELECT doc_id, target FROM links",
    "broken_links": _PAGES + _BROKEN,
    "mentioned_missing": _PAGES + f"SELECT * FROM ({_BROKEN}) WHERE pages >= 2",
    "orphan_pages": _PAGES + "SELECT name FROM names WHERE name NOT IN (SELECT target FROM links WHERE target <> name)",
    "index_drift": _PAGES
    + """, e AS (SELECT DISTINCT target FROM links WHERE name = 'index'), n AS (SELECT name FROM names WHERE name <> 'index')
SELECT target, 'missing page' AS drift FROM e WHERE target NOT IN (SELECT name FROM n) UNION ALL SELECT name, 'not listed' FROM n WHERE name NOT IN (SELECT target FROM e)""",
    "thin_oversized": _PAGES + "SELECT doc_id, words, CASE WHEN words < 100 THEN 'thin' ELSE 'oversized' END AS size FROM pages WHERE words < 100 OR words > 2000",
    "format_issues": _PAGES
    + r"""SELECT doc_id, issue FROM (SELECT doc_id, unnest([CASE WHEN type IS NULL THEN 'no type' WHEN type NOT IN ('entity', 'concept', 'source', 'synthesis') THEN 'unknown type' END,
 CASE WHEN len(tags) = 0 THEN 'no tags' END, CASE WHEN regexp_replace(title, '@E', '', 'g') <> '' THEN 'title in front matter' END, CASE WHEN regexp_matches(body, '(?m)^# +[^\n]') THEN 'heading of level one' END,
 CASE WHEN NOT regexp_matches(body, '(?m)^## Sources *$') THEN 'no sources' END]) AS issue FROM pages) WHERE issue IS NOT NULL""".replace("@E", f"^{_S}+|{_S}+$"),
    "log_entries": _PAGES
    + r"""SELECT doc_id, m.date, m.verb, m.subject FROM (SELECT doc_id, regexp_extract(line, '^## \[(\d{4}-\d{2}-\d{2})\] (\w+) \| ([^\n]*)$', ['date', 'verb', 'subject']) AS m FROM
 (SELECT doc_id, unnest(regexp_extract_all(body, '(?m)^## \[\d{4}-\d{2}-\d{2}\] \w+ \| [^\n]*$')) AS line FROM pages))""",
    "tag_counts": _PAGES + "SELECT tag, count(*) AS pages FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM pages) GROUP BY tag",
    "duplicate_docs": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "discouraged_commands": _BASE
    + rf""", x AS ({_COMMANDS}), y AS (SELECT list_transform(regexp_split_to_array(command, '[|;&()\n`]+|\$\('), lambda p: regexp_extract(regexp_extract(p, '^\s*(\S+)', 1), '[^/]*$')) AS w FROM x),
 z AS (SELECT list_contains(w, 'cat') AS f, list_contains(w, 'ls') AS g FROM y)
SELECT CASE WHEN f AND g THEN '[warning] this command used ''cat'' and ''ls''; prefer ''read'' and ''tree''' WHEN f THEN '[warning] this command used ''cat''; prefer ''read''' ELSE '[warning] this command used ''ls''; prefer ''tree''' END AS warning, count(*) AS n FROM z WHERE f OR g GROUP BY 1""",
    "command_swap": _BASE + rf", x AS ({_COMMANDS}) SELECT path, line_no, regexp_replace(regexp_replace(command, '\bcat\b', 'read', 'g'), '\bls\b', 'tree', 'g') AS command FROM x",
    "question_labels": _BASE
    + """, q AS (SELECT path, line_no, unnest(CAST(json_extract(args, '$.questions') AS JSON[])) AS q, CAST(generate_subscripts(CAST(json_extract(args, '$.questions') AS JSON[]), 1) AS INT) AS number
 FROM c WHERE name = 'ask_user' AND json_type(args, '$.questions') = 'ARRAY')
SELECT path, line_no, number, coalesce(nullif(q->>'$.label', ''), 'Q' || number) AS label, CAST(coalesce(json_array_length(q, '$.options'), 0) AS INT) AS options,
 coalesce(len(list_filter(CAST(json_extract(q, '$.options') AS JSON[]), lambda o: o->>'$.recommended' = 'true')), 0) <= 1 AS valid FROM q""",
    "visible_tools": _BASE
    + """, t AS (SELECT path, line_no, trim(block->>'$.name') AS name, min(pos) AS pos FROM b WHERE block->>'$.type' = 'toolCall' AND trim(block->>'$.name') NOT IN ('', 'grep') GROUP BY 1, 2, 3)
SELECT path, line_no, string_agg(name, ', ' ORDER BY pos) AS tools FROM t GROUP BY 1, 2""",
    "confidence_gate": """SELECT o_orderpriority AS axis, count(*) AS kept, CAST(sum(o_orderkey % 101) AS BIGINT) AS score FROM orders WHERE o_orderkey % 101 >= 80 GROUP BY 1""",
    "filter_sort_limit": """SELECT o_orderkey, printf('%.1fK', floor(o_totalprice) / 1000.0) AS price FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""",
    "set_ops": """WITH c AS (SELECT DISTINCT c_nationkey AS nation FROM customer), s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier)
SELECT 'union' AS set, nation FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'both', nation FROM c WHERE nation IN (SELECT nation FROM s) UNION ALL SELECT 'only customers', nation FROM c WHERE nation NOT IN (SELECT nation FROM s)""",
    "prompt_template": r"""SELECT doc_id, 'Source: ' || CASE WHEN source <> '' THEN source || chr(10) || chr(10) ELSE '' END || CASE WHEN lang <> '' THEN lang || chr(10) || chr(10) ELSE '' END
 || 'Space: ' || CASE WHEN space <> '' THEN space ELSE '{{space}}' END || ' {{space}}' AS prompt FROM documents""",
}
