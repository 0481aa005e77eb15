"""Queries of the smaller parts of the library over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import clock, lines, paths, scores
from sparkloom.functions import text as text_functions
from sparkloom.operators import graph, pages, records
from sparkloom.plans.graph import _EDGES, _NODES, _REACH, part_edges, part_nodes, place_edges, place_nodes
from sparkloom.session import table


def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of every file by their start line, the first fifty with the number of all."""
    return graph.file_symbols(part_nodes(spark, d)).select("file_path", "id", "rank", "of")


def members_shown(spark: SparkSession, d: str) -> DataFrame:
    """Members of every nation and region by line, the first fifty with the number of all and the note."""
    rows = graph.members_shown(place_nodes(spark, d), place_edges(spark, d))
    return rows.select("parent", "id", "rank", graph.more_note(F.lit(50), F.col("of")).alias("more"))


def dependents_shown(spark: SparkSession, d: str) -> DataFrame:
    """The first eight files that depend on each file."""
    return graph.dependents_shown(graph.file_dependents(part_nodes(spark, d), part_edges(spark, d))).select("path", "dependent", "rank", "of")


def expansion_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty parts reached, by depth, with the number of all of a depth."""
    sources = table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    reached = graph.expand(part_edges(spark, d), sources, 6, paths=False).filter("depth > 0")
    return graph.shown_by_depth(reached).select("depth", "id", "rank", "of")


def callees_of(spark: SparkSession, d: str) -> DataFrame:
    """What the parts divisible by 100 lead to within two hops."""
    sources = table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    return graph.callees(part_edges(spark, d), sources, 2).select("id", "depth")


def neighbor_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as text: whom it leads to, where, and how sure."""
    nodes = part_nodes(spark, d).select(F.col("id").alias("dst"), "name", "file_path", "start_line")
    inferred = F.col("confidence") < 0.95
    shown = graph.neighbor_text(F.col("name"), F.col("file_path"), F.col("start_line"), F.col("kind"), inferred)
    return part_edges(spark, d).join(nodes, "dst").groupBy(shown.alias("shown")).agg(F.count("*").alias("n"))


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many edges have their evidence at each place; a line of 0 is unknown."""
    files = part_nodes(spark, d).select(F.col("id").alias("src"), "file_path")
    edges = part_edges(spark, d).join(files, "src")
    return edges.groupBy(graph.evidence(F.col("file_path"), F.col("line") - 1).alias("evidence")).agg(F.count("*").alias("n"))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Routes in scope: the methods among the parts."""
    nodes = part_nodes(spark, d).withColumn("kind", F.when(F.col("kind") == "method", "route").otherwise(F.col("kind")))
    return graph.routes(nodes, "main").select("id", "file_path")


def code_slices(spark: SparkSession, d: str) -> DataFrame:
    """The third to fifth line of every document, as source of a symbol there."""
    texts = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    nodes = texts.select(F.concat(F.lit("n"), "path").alias("id"), F.col("path").alias("file_path"), F.lit(3).alias("start_line"), F.lit(5).alias("end_line"))
    return lines.sources_of(texts, nodes)


def shortened_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than two hundred lines, cut with a note."""
    texts = table(spark, d, "documents").filter("text is not null")
    return texts.select("doc_id", lines.shortened(F.col("text")).alias("shown"), F.size(lines.body_lines(F.col("text"))).alias("n")).filter("n > 200").select("doc_id", F.length("shown").alias("size"), F.substring_index("shown", "\n", -1).alias("note"))


def capped_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than 40,000 characters, cut at a blank line or a line end."""
    return table(spark, d, "documents").filter(F.length("text") > 40_000).select("doc_id", F.length(lines.capped(F.col("text"))).alias("size"))


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the language of their path."""
    known = table(spark, d, "documents").filter("path is not null")
    return known.groupBy(paths.file_language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def query_forms(spark: SparkSession, d: str) -> DataFrame:
    """Paths typed as queries, with spaces and a mark around them."""
    typed = F.concat(F.lit("  @"), "path", F.lit(" \t"))
    return table(spark, d, "documents").filter("path is not null").select("doc_id", paths.query_form(typed).alias("query"))


def episode_ids(spark: SparkSession, d: str) -> DataFrame:
    """Episode numbers of addresses made of orders."""
    key = F.col("o_orderkey").cast("string")
    source = F.when(F.col("o_orderkey") % 4 == 0, key).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("https://pod.example/show/id9?i="), key, F.lit("&l=en")))
    source = source.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("https://pod.example/x?l=en&i="), key)).otherwise(F.concat(F.lit("https://pod.example/id"), key))
    return table(spark, d, "orders").select("o_orderkey", paths.episode_id(source).alias("episode"))


def compact_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders written without marks and read back."""
    return table(spark, d, "orders").select("o_orderkey", clock.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"))


def duration_classes(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of recordings by class."""
    lengths = table(spark, d, "cues").groupBy("doc_id").agg((F.max("seconds") - F.min("seconds")).alias("seconds")).filter("seconds is not null")
    return lengths.groupBy(records.duration_class(F.col("seconds")).alias("class")).agg(F.count("*").alias("n"))


def verdict_bands(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the band of a score."""
    return table(spark, d, "orders").groupBy(records.verdict(F.col("o_orderkey") % 11).alias("verdict")).agg(F.count("*").alias("n"))


def short_titles(spark: SparkSession, d: str) -> DataFrame:
    """First lines of documents, cut with an ellipsis."""
    first = F.get(lines.body_lines(F.col("text")), F.lit(0))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text_functions.ellipsis(first).alias("title"))


def _filed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: their directory by source, their name by path."""
    folder = F.when(F.col("source") == "wiki", "insights").when(F.col("source") == "readme", "archive/sources").otherwise("inbox")
    name = F.concat(F.date_format("created", "yyyy-MM-dd"), F.when(F.col("doc_id") % 3 == 0, "-Note ").otherwise("-note-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", folder.alias("dir"), name.alias("name"))


def undistilled(spark: SparkSession, d: str) -> DataFrame:
    """Source files that no insight names: insights are made from every second one."""
    files = _filed(spark, d)
    insights = files.filter("dir = 'archive/sources' and doc_id % 2 = 0").select(F.concat(F.lit("archive/sources/"), "name").alias("source"))
    return pages.undistilled(files, insights).select("doc_id")


def malformed_names(spark: SparkSession, d: str) -> DataFrame:
    """Insights whose name isn't of the right form."""
    return pages.malformed_names(_filed(spark, d)).select("doc_id")


def archive_status(spark: SparkSession, d: str) -> DataFrame:
    """Files by status once every second file of the inbox is processed."""
    files = _filed(spark, d)
    return pages.archived(files, files.filter("dir = 'inbox' and doc_id % 2 = 0")).groupBy("dir", "status").agg(F.count("*").alias("n"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log headings of documents and what is read back from them."""
    heading = pages.log_line(F.date_format("created", "yyyy-MM-dd"), F.lit("ingest"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return pages.log_entries(table(spark, d, "documents").select("doc_id", heading.alias("body"))).select("doc_id", "date", "verb", "subject")


def labelled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the label of their question, where it has one: orders answer customers."""
    asked = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"))
    answers = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("value"))
    return records.labelled_answers(answers, asked).select("value", "label")


def subtitle_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of metadata made of documents: one manual and two automatic tracks each."""
    entry = lambda ext, url: F.struct(F.lit(ext).alias("ext"), url.alias("url"), F.lit(None).cast("string").alias("name"))
    lang, url = F.coalesce("lang", F.lit("und")), F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    manual = F.create_map(lang, F.array(entry("VTT", url), entry("mp4", url)))
    automatic = F.create_map(F.lit("live_chat"), F.array(entry("json3", url)), F.lit("en"), F.array(entry("json3", F.when(F.col("doc_id") % 2 == 0, url)), entry("srv1", url)))
    return scores.subtitle_candidates(table(spark, d, "documents").select(F.col("doc_id").alias("id"), manual.alias("subtitles"), automatic.alias("automatic_captions"))).select("id", "ordinal", "source_kind", "language", "ext")


def tree_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs of a syntax tree built around every event: one call inside another."""
    inner = F.struct(F.lit("Command").alias("type"), F.struct(F.col("event_type").alias("value")).alias("name"))
    tree = F.to_json(F.struct(F.lit("Script").alias("type"), F.struct(F.lit("Command").alias("type"), F.struct(F.lit("run").alias("value")).alias("name"), F.array(inner).alias("args")).alias("body")))
    return table(spark, d, "events").groupBy(F.array_join(records.tree_programs(tree), " ").alias("programs")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_symbols, members_shown, dependents_shown, expansion_by_depth, callees_of, neighbor_texts, edge_evidence, entry_points, code_slices, shortened_bodies,
        capped_outputs, file_languages, query_forms, episode_ids, compact_dates, duration_classes, verdict_bands, short_titles, undistilled, malformed_names,
        archive_status, log_lines, labelled_answers, subtitle_candidates, tree_programs,
    )
}

_ALL = _EDGES.replace(" WHERE l_quantity <= 10", "")
_FULL = _ALL.replace("SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src,", "SELECT DISTINCT * FROM (SELECT l_partkey AS src, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'references' ELSE 'instantiates' END AS kind, l_linenumber AS line, 1 - l_discount AS conf,")
_FILED = """f AS (SELECT doc_id, CASE source WHEN 'wiki' THEN 'insights' WHEN 'readme' THEN 'archive/sources' ELSE 'inbox' END AS dir FROM documents)"""

SQL = {
    "file_symbols": f"""WITH {_NODES} SELECT file_path, id, CAST(row_number() OVER w AS INT) AS rank, count(*) OVER (PARTITION BY file_path) AS of FROM nodes WHERE kind <> 'file'
 WINDOW w AS (PARTITION BY file_path ORDER BY start_line, id) QUALIFY row_number() OVER w <= 50""",
    "members_shown": """WITH m AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
 r AS (SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY id) AS rank, count(*) OVER (PARTITION BY parent) AS of FROM m)
SELECT parent, id, CAST(rank AS INT) AS rank, CASE WHEN of > 50 THEN '+' || (of - 50) || ' more' ELSE '' END AS more FROM r WHERE rank <= 50""",
    "dependents_shown": f"""WITH {_ALL}, {_NODES}, p AS (SELECT DISTINCT b.file_path AS path, a.file_path AS dependent FROM e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.file_path <> b.file_path)
SELECT path, dependent, CAST(row_number() OVER w AS INT) AS rank, count(*) OVER (PARTITION BY path) AS of FROM p WINDOW w AS (PARTITION BY path ORDER BY dependent) QUALIFY row_number() OVER w <= 8""",
    "expansion_by_depth": _REACH.format(edges=_ALL, t="e", depth=6, more="")
    + """, m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0)
SELECT depth, id, CAST(row_number() OVER (ORDER BY depth, id) AS INT) AS rank, count(*) OVER (PARTITION BY depth) AS of FROM m QUALIFY row_number() OVER (ORDER BY depth, id) <= 60""",
    "callees_of": _REACH.format(edges=_ALL, t="e", depth=2, more="") + " SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0",
    "neighbor_texts": f"""WITH {_FULL}, {_NODES} SELECT name || ' (' || file_path || ':' || start_line || ') [' || e.kind || CASE WHEN conf < 0.95 THEN ' (inferred)' ELSE '' END || ']' AS shown, count(*) AS n
 FROM e JOIN nodes ON e.dst = nodes.id GROUP BY 1""",
    "edge_evidence": f"""WITH {_FULL}, {_NODES} SELECT file_path || CASE WHEN line > 1 THEN ':' || (line - 1) ELSE '' END AS evidence, count(*) AS n FROM e JOIN nodes ON e.src = nodes.id GROUP BY 1""",
    "entry_points": f"WITH {_NODES} SELECT id, file_path FROM nodes WHERE kind = 'method' AND starts_with(file_path, 'src/main/')",
    "code_slices": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT 'n' || doc_id AS id, array_to_string(l[3:5], chr(10)) AS code FROM t WHERE len(l) >= 3""",
    "shortened_bodies": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(array_to_string(l[1:200], chr(10)) || chr(10) || '(first 200 of ' || len(l) || ' lines)') AS INT) AS size, '(first 200 of ' || len(l) || ' lines)' AS note FROM t WHERE len(l) > 200""",
    "capped_outputs": r"""WITH t AS (SELECT doc_id, left(text, 40000) AS c FROM documents WHERE length(text) > 40000),
 p AS (SELECT doc_id, 40000 - strpos(reverse(c), chr(10) || chr(10)) - 1 AS blank, strpos(c, chr(10) || chr(10)) > 0 AS has_blank, 40000 - strpos(reverse(c), chr(10)) AS line, strpos(c, chr(10)) > 0 AS has_line FROM t)
SELECT doc_id, CAST(CASE WHEN has_blank AND blank > 20000 THEN blank WHEN has_line THEN line ELSE 0 END + length(chr(10) || chr(10) || '… (output truncated)') AS INT) AS size FROM p""",
    "file_languages": r"""WITH x AS (SELECT regexp_extract(path, '(?:^|/)[^/]*[^/.][^/]*?\.([^./]*)$', 1) AS x FROM documents WHERE path IS NOT NULL)
SELECT CASE x WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'h' THEN 'c' WHEN 'hpp' THEN 'cpp' WHEN 'kt' THEN 'kotlin' ELSE x END AS language, count(*) AS n FROM x GROUP BY 1""",
    "query_forms": "SELECT doc_id, trim(path) AS query FROM documents WHERE path IS NOT NULL",
    "episode_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey AS VARCHAR) END AS episode FROM orders",
    "compact_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "duration_classes": "SELECT CASE WHEN s < 300 THEN 'short' WHEN s > 1200 THEN 'long' ELSE 'medium' END AS class, count(*) AS n FROM (SELECT max(seconds) - min(seconds) AS s FROM cues GROUP BY doc_id) WHERE s IS NOT NULL GROUP BY 1",
    "verdict_bands": "SELECT CASE WHEN o_orderkey % 11 >= 8 THEN 'good' WHEN o_orderkey % 11 >= 5 THEN 'fair' ELSE 'poor' END AS verdict, count(*) AS n FROM orders GROUP BY 1",
    "short_titles": "SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(left(t, 59), ' ') || '…' ELSE t END AS title FROM (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))[1] AS t FROM documents WHERE text IS NOT NULL)",
    "undistilled": f"WITH {_FILED} SELECT doc_id FROM f WHERE dir = 'archive/sources' AND doc_id % 2 <> 0",
    "malformed_names": f"WITH {_FILED} SELECT doc_id FROM f WHERE dir = 'insights' AND doc_id % 3 = 0",
    "archive_status": f"WITH {_FILED} SELECT dir, CASE WHEN dir = 'archive/sources' OR (dir = 'inbox' AND doc_id % 2 = 0) THEN 'archived' ELSE 'active' END AS status, count(*) AS n FROM f GROUP BY 1, 2",
    "log_lines": "SELECT doc_id, strftime(created, '%Y-%m-%d') AS date, 'ingest' AS verb, 'Document ' || doc_id AS subject FROM documents WHERE created IS NOT NULL",
    "labelled_answers": "SELECT o_orderkey AS value, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE CAST(o_custkey AS VARCHAR) END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "subtitle_candidates": """SELECT doc_id AS id, CAST(o AS INT) AS ordinal, k AS source_kind, l AS language, x AS ext FROM (
 SELECT doc_id, 0 AS o, 'manual' AS k, coalesce(lang, 'und') AS l, 'vtt' AS x FROM documents UNION ALL
 SELECT doc_id, 3, 'automatic', 'en', 'json3' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 4, 'automatic', 'en', 'srv1' FROM documents)""",
    "tree_programs": "SELECT CASE WHEN event_type IS NULL THEN 'run' ELSE 'run ' || event_type END AS programs, count(*) AS n FROM events GROUP BY 1",
}
