from __future__ import annotations

import json
import time

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sparkloom.functions import clock, lines, ordered, paths, scores, text
from sparkloom.operators import graph, logs, pages, records, timed_text
from sparkloom.sources import jsonl, subtitles


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def texts(make, values):
    return make([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")


# --- functions ---------------------------------------------------------------------------------


def test_path_functions(make):
    values = ["a/b.tar.gz", ".bashrc", "x/.a.b", "foo.", "src/foo.spec.ts", "CREDIT.java", "src/Test/a.py", "generated/x.ts", "UserTest.java"]
    got = texts(make, values).select(paths.suffix(F.col("v")).alias("s"), paths.in_scope(F.col("v"), "main").alias("m"), paths.in_scope(F.col("v"), "test").alias("t"), paths.file_language(F.col("v")).alias("l")).collect()
    assert [r.s for r in got] == [".gz", "(none)", ".b", "(none)", ".ts", ".java", ".py", ".ts", ".java"]
    assert [r.m for r in got] == [True, True, True, True, True, False, False, False, False]
    assert [r.t for r in got] == [False, False, False, False, False, True, True, False, True]
    assert [r.l for r in got][:6] == ["gz", "", "b", "", "typescript", "java"]
    heads = ["(cd x && y)", "", "  ", "/usr/bin/rg -n x", "((ls))", None, "bin/ a"]
    assert [r.h for r in texts(make, heads).select(paths.command_head(F.col("v")).alias("h")).collect()] == ["cd", "(empty)", "(empty)", "rg", "ls))", "(empty)", ""]


def test_text_and_clock_functions(spark, make):
    values = ["a &amp; <b>b</b>\xa0 c , d", None, "É'a-B …"]
    got = texts(make, values).select(text.caption_text(F.col("v")).alias("c"), text.caption_tokens(F.col("v")).alias("t")).collect()
    assert [r.c for r in got] == ["a & b c, d", None, "É'a-B …"] and got[2].t == ["é'ab", ""]
    assert one(spark, text.spoken_text(F.lit("a  ( b )  [ c ] !"))) == "a (b) [c]!"
    clocks = [(59.9, "00:59"), (3599.0, "59:59"), (3600.0, "01:00:00"), (360000.0, "100:00:00")]
    assert [r.c for r in make(clocks, "s double, e string").select(clock.format_clock(F.col("s")).alias("c")).collect()] == [c for _, c in clocks]
    assert [one(spark, clock.parse_clock(F.lit(v))) for v in ("1:02:03.5", "2:03", "7", "x")] == [3723.5, 123.0, 7.0, None]
    assert [one(spark, clock.compact_date(F.lit(v))) for v in ("20260131", "20260231", "x")] == ["2026-01-31", None, None]
    assert [one(spark, text.abbreviated(F.lit(v))) for v in (999, 1500, 2300000)] == ["999", "1.5K", "2.3M"]
    assert one(spark, text.filled_template(F.lit("{{a}} {{a}}\n\n{{b}}\n\nc"), {"a": F.lit("$1"), "b": F.lit("")})) == "$1 {{a}}\n\nc"
    assert one(spark, text.quoted(F.lit('a "b" é'))) == '"a \\"b\\" é"'
    assert [one(spark, logs.bar(F.lit(v), 4)) for v in (0.125, 0.375, 1.0)] == ["....", "##..", "####"]


def test_line_functions(spark, make):
    assert one(spark, lines.numbered(F.lit("a\nb\n"), 5)) == "5\ta\n6\tb"
    assert one(spark, lines.shortened(F.lit("a\nb\nc"), 2)) == "a\nb\n(first 2 of 3 lines)"
    assert one(spark, lines.capped(F.lit("aaaa\n\nbbbb"), 8)) == "aaaa\n\n\n… (output truncated)"
    assert one(spark, lines.capped(F.lit("a\n\nbb\nbbbbbb"), 8)) == "a\n\nbb\n\n… (output truncated)"
    hits = lines.literal_hits(make([(1, "x y\ny\nx"), (2, None)], "doc_id int, text string"), "doc_id", "x", 1)
    assert rows_of(hits) == [(1, 1, "x y")]
    nodes = make([("n", "f", 2, 3)], "id string, file_path string, start_line int, end_line int")
    assert rows_of(lines.sources_of(make([("f", "l1\nl2\nl3\nl4\n")], "path string, text string"), nodes)) == [("n", "l2\nl3")]


def test_looking_back_over_blocks(make):
    rows = make([(k, i, i * 2) for k in (1, 2, None) for i in range(50)], "k int, i int, v int")
    block = F.floor(F.col("i") / 7)
    back = ordered.with_previous(rows, "k", ["i"], F.col("v"), block)
    assert all(r.previous == (None if r.i == 0 else r.v - 2) for r in back.collect()) and back.count() == 150
    sums = ordered.with_running_sum(rows, "k", ["i"], F.col("v"), block, "s")
    assert all(r.s == sum(range(0, r.v + 1, 2)) for r in sums.collect())


def test_candidates(spark, make):
    metadata = spark.createDataFrame([("v", {"en": [("vtt", "u1", "")], "live_chat": [("json3", "u", "")]}, {"de-AT": [("json3", "u2", ""), ("doc", "u3", "")], "en": [("srv1", "", "")]})],
        "id string, subtitles map<string,array<struct<ext:string,url:string,name:string>>>, automatic_captions map<string,array<struct<ext:string,url:string,name:string>>>")
    found = scores.subtitle_candidates(metadata)
    assert rows_of(found, "source_kind", "language", "ext") == [("automatic", "de-AT", "json3"), ("manual", "en", "vtt")]
    best = scores.best_candidates(found, "id", ["de"], None).first()
    assert (best.language, best.score) == ("en", 1000 + 0 + 40 + 10)


# --- timed text --------------------------------------------------------------------------------


def test_subtitle_formats(make):
    vtt = "﻿WEBVTT\n\nNOTE x\n\n1\n00:01.500 --> 00:02.000\n<c>Hello</c>\nthere , you\n\n00:00:05.000 --> 1\n12\n&nbsp;\n"
    files = [
        (1, "vtt", vtt), (2, "SRT", vtt.replace("01.500", "01,500")), (3, "json3", json.dumps({"events": [{"tStartMs": 1500, "segs": [{"utf8": "Hello "}, {"utf8": "there"}]}, {"tStartMs": 1}]})),
        (4, "ttml", '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="m" xml:lang="en"><body><p begin="0:01.5" ttm:agent="A">Hello <b>dear</b> you</p><p>x</p></body></tt>'),
        (5, "srv1", '<transcript><text start="1.5">Hello</text></transcript>'), (6, "srv3", '<timedtext><p t="1500">Hello</p></timedtext>'), (7, "doc", "x"), (8, "json3", "{"), (9, "vtt", None),
    ]
    cues, failed = subtitles.parse_subtitles(make(files, "doc_id int, ext string, payload string"))
    got = {r.doc_id: (r.seconds, r.text, r.speaker) for r in cues.collect()}
    assert got == {1: (1.5, "Hello there, you", None), 2: (1.5, "Hello there. you", None), 3: (1.5, "Hello there", None), 4: (1.5, "Hello dear you", "A"), 5: (1.5, "Hello", None), 6: (1.5, "Hello", None)}
    assert rows_of(failed, "doc_id") == [(7,), (8,), (9,)]
    assert make(files[3:4], "doc_id int, ext string, payload string").select(subtitles.xml_language(F.col("payload")).alias("l")).first().l == "en"


def test_merging_of_fragments(make):
    cues = [
        (1, 1, 0.0, "we go"), (1, 2, 2.0, "go on"), (1, 3, 3.2, "on now."), (1, 4, 3.3, "Next"), (1, 5, 6.6, "far"), (1, 6, 6.6, "far"),
        (1, 7, 8.0, "far"), (2, 1, 599.0, "a b"), (2, 2, 601.0, "b c"), (2, 3, 700.0, None), (3, 1, None, "x"), (2, 4, 900.0, "a b"),
    ]
    table = make(cues + cues[:2], "doc_id int, seq int, seconds double, text string")
    got = rows_of(timed_text.finished(table), "doc_id", "seq", "timestamp", "text")
    assert got == [(1, 1, "00:00", "we go on now."), (1, 4, "00:03", "Next"), (1, 5, "00:06", "far"), (2, 1, "09:59", "a b c"), (2, 4, "15:00", "a b")]
    assert rows_of(timed_text.drop_repeats(timed_text.distinct_cues(table)), "doc_id", "seq")[4:6] == [(1, 5), (2, 1)]
    long = [{"seconds": 0.0, "seq": 1, "text": " ".join(f"w{i}" for i in range(79))}, {"seconds": 1.0, "seq": 2, "text": "x y"}, {"seconds": 1.1, "seq": 3, "text": "z"}]
    assert [len(c["text"].split()) for c in timed_text.merged(long)] == [81, 1]


# --- logs --------------------------------------------------------------------------------------


def entry(**message):
    return json.dumps({"type": "message", "message": message})


LOG = [
    "", "broken {", "[1]", '{"type": "session", "cwd": "/w/proj", "timestamp": "2026-03-01T00:00:00Z"}',
    entry(role="user", content="hi"),
    entry(role="assistant", model="m1", usage={"input": 10, "totalTokens": 15, "cacheRead": None, "cost": {"total": 0.5}}, content=[
        {"type": "toolCall", "name": "read", "arguments": {"path": ["a.py", "b.py", 3], "offset": 0}}, {"type": "toolCall", "name": "read", "arguments": {"file": "c.d.ts", "limit": 5}},
        {"type": "toolCall", "arguments": "text"}, {"type": "toolCall", "name": "bash", "input": {"command": "(cd x && y)"}}, {"type": "toolCall", "name": "edit", "arguments": {"filePath": "e.md"}},
        {"type": "text", "text": "one"}, {"type": "text", "text": "two"}]),
    entry(role="toolResult", toolName="read", isError=True), entry(role="toolResult", toolName="never", isError=True), entry(role="toolResult", isError=False),
]


def test_log_report(make):
    rows = [("d/projx/s1.jsonl", i, line, "t") for i, line in enumerate(LOG, 1)] + [("d/other/s2.jsonl", 1, entry(role="user", content=None), "t")]
    table = make(rows + rows[3:6], "path string, line_no bigint, line string, loaded_at string")
    sections = {name: df.collect() for name, df in logs.report(table).items()}
    assert (sections["overview"][0].messages, sections["overview"][0].sessions, sections["overview"][0].total, sections["overview"][0].cost) == (6, 2, 15, 0.5)
    assert [(r.name, r.calls, r.errors, r.rate) for r in sections["tools"]] == [("read", 2, 1, 50.0), ("?", 1, 0, 0.0), ("bash", 1, 0, 0.0), ("edit", 1, 0, 0.0)]
    assert [(r.extension, r.reads, r.ranged, r.full, r.edits) for r in sections["files"]] == [(".py", 2, 0, 2, 0), (".ts", 1, 1, 0, 0)]
    assert [(r.head, r.n) for r in sections["bash"]] == [("cd", 1)]
    assert [(r.project, r.cost, r.calls) for r in sections["sessions"]] == [("proj", 0.5, 5), ("other", 0.0, 0)]
    assert logs.filter_sessions(logs.sessions(logs.entries(table)), since="2026-04-01").count() == 1
    assert logs.filter_sessions(logs.sessions(logs.entries(table)), until="2026-03-01", projects=("pro",)).count() == 0
    assert [r.text for r in logs.last_assistant_texts(logs.messages(logs.entries(table))).collect()] == ["one\n\ntwo"]
    filtered = logs.report(table, model="other")["overview"].first()
    assert (filtered.messages, filtered.total) == (6, 0)
    assert logs.report_json(logs.report(table.limit(0)), ("tools", "cache")).count() == 1


def test_json_lines_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.jsonl").write_bytes(b'{"type": "session"}\n\nbad \xff byte\n')
    (tmp_path / "x.txt").write_text("no")
    got = jsonl.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.path.rpartition("/")[2], r.line_no, r.line) for r in got] == [("s.jsonl", 1, '{"type": "session"}'), ("s.jsonl", 2, ""), ("s.jsonl", 3, "bad  byte")]
    (tmp_path / "index.md").write_text("x")
    (tmp_path / "Page One.md").write_text("body")
    assert rows_of(jsonl.read_pages(spark, str(tmp_path)), "name", "body") == [("Page One", "body")]
    assert jsonl.newest_file(spark, str(tmp_path), r"\.md$").count() == 1


# --- graph -------------------------------------------------------------------------------------

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int"
EDGES = "src string, dst string, kind string, line int, resolved_by string, synthesized_by string, confidence double"


def edge(src, dst, kind="calls", line=1, by=None, made=None, sure=None):
    return (src, dst, kind, line, by, made, sure)


@pytest.fixture
def layered(make):
    """Route, controller, use case, port (interface) and its implementation, with siblings."""
    nodes = [
        ("r", "route", "POST /p", "POST /p", "src/main/C.java", 1), ("C", "class", "Controller", "Controller", "src/main/C.java", 1), ("c.create", "method", "create", "Controller.create", "src/main/C.java", 5),
        ("P", "interface", "Port", "Port", "src/main/P.java", 1), ("p.add", "method", "add", "Port.add", "src/main/P.java", 2), ("p.find", "method", "find", "Port.find", "src/main/P.java", 3),
        ("I", "class", "PortImpl", "PortImpl", "src/main/I.java", 1), ("i.add", "method", "add", "PortImpl.add", "src/main/I.java", 4), ("t", "function", "addTest", "addTest", "src/test/T.java", 1),
        ("x", "field", "port", "Controller.port", "src/main/C.java", 2), ("f", "file", "C.java", "C.java", "src/main/C.java", 0),
    ]
    edges = [
        edge("C", "c.create", "contains"), edge("P", "p.add", "contains"), edge("P", "p.find", "contains"), edge("I", "i.add", "contains"), edge("C", "x", "contains"),
        edge("r", "c.create", "references", 3), edge("c.create", "p.add", "calls", 6), edge("p.add", "p.find", "calls", 9), edge("I", "P", "implements", 1), edge("p.add", "i.add", "calls", 2, None, "interface-impl"),
        edge("t", "p.add", "calls", 1, None, None, 0.5), edge("i.add", "c.create", "calls", 8),
    ]
    return make(nodes, NODES), make(edges, EDGES)


def test_resolution(layered):
    nodes, edges = layered
    order = [r.id for r in graph.candidates(nodes, "port").orderBy("position").collect()]
    assert order[:2] == ["x", "P"]  # the exact name first, the interface as alternative
    assert graph.candidates(nodes, "Port").orderBy("position").first().id == "P"
    got = {r.role: r for r in graph.resolve(nodes.filter("id = 't'"), "addTest", "main").collect()}
    assert got["primary"].out_of_scope and got["primary"].id == "t"
    assert [(r.id, r.tier) for r in graph.resolve_qualified(nodes, edges, "port.ADD").collect()] == [("p.add", 1)]
    assert graph.resolve_qualified(nodes, edges, "Port.none").count() == 0 and graph.resolve_qualified(nodes, edges, "Port").count() == 0
    assert graph.candidates(nodes, "crate").filter("tier = 3").count() > 0
    names = {r.id: r.display for r in graph.display_names(nodes, graph.ancestors(edges)).collect()}
    assert names["p.add"] == "Port.add" and names["P"] == "Port" and names["r"] == "POST /p" and names["t"] == "addTest"


def test_expansion_and_paths(layered, make):
    nodes, edges = layered
    ids = lambda *values: make([(v,) for v in values], "id string")
    down = {r.id: (r.depth, r.label) for r in graph.expansion(nodes, edges, ids("r")).collect()}
    assert down["c.create"] == (1, "high") and down["p.add"] == (2, "high") and down["i.add"] == (3, "inferred · interface dispatch")
    up = {r.id: r.depth for r in graph.expansion(nodes, edges, ids("p.add"), "up", "main").collect()}
    assert up == {"c.create": 1, "r": 2, "i.add": 2}
    paths_found = graph.member_paths(nodes, edges, ids("r"), ids("P"), most=None)
    assert rows_of(paths_found, "leaf", "hops") == [("p.add", 2)]  # the sibling behind it is not reached
    assert rows_of(graph.unreached_members(nodes, edges, ids("P"), paths_found), "leaf") == [("p.find",)]
    assert rows_of(graph.member_paths(nodes, edges, ids("p.add"), ids("P"), most=None), "leaf", "hops")[0] == ("p.add", 0)
    dispatch = graph.expand(graph.forward_edges(nodes, edges), ids("P"), 1)
    assert "I" in {r.id for r in dispatch.collect()}
    assert rows_of(graph.impact_radius(edges, ids("p.add"), 1), "id") == [("c.create",), ("t",)]
    assert rows_of(graph.routes(nodes), "id") == [("r",)]
    assert rows_of(graph.file_dependents(nodes, edges.filter("kind = 'calls' and src = 'c.create'"))) == [("src/main/P.java", "src/main/C.java")]
    assert graph.expand(edges.limit(0), ids("r")).count() == 1 and graph.clamp_depth(None) == 6 and graph.clamp_depth(99) == 12


def test_shortest_of_a_diamond_and_wide_fan(make):
    steps = make([("s", f"l{i}") for i in range(300)] + [("l7", "t"), ("s", "a"), ("a", "b"), ("b", "t")], "src string, dst string")
    seeds = make([("s",)], "id string")
    got = {r.id: (r.depth, r.path) for r in graph.expand(steps, seeds).collect()}
    assert len(got) == 304 and got["t"] == (2, ["s", "l7", "t"])


def test_file_lookup(make):
    files = make([("src/a/User.ts",), ("lib/user.ts",), ("src/user.ts.bak",)], "path string")
    assert rows_of(graph.find_files(files, "./USER.ts"), "path") == [("lib/user.ts",), ("src/a/User.ts",)]
    assert rows_of(graph.find_files(files, "src/a/user.ts"), "level") == [(0,)]


# --- pages and records -------------------------------------------------------------------------


def test_page_checks(make):
    rows = [
        (1, "w/One.md", "---\r\ntype: concept\r\ntags: [a, b ]\r\n---\r\nSee [[Two]], [[Gone|x]] and [[One]].\n\n## Sources\n\n- [[2026-01-01-x]]\n"),
        (2, "w/Two.md", "# Two\n[[gone]]"), (3, "w/index.md", "# Index\n- [[Two]] — x\n- [[Lost]] — y"), (4, None, None), (5, "w/log.md", "## [2026-01-02] ingest | What it was\n" + "word " * 2500),
    ]
    table = pages.pages(make(rows, "doc_id int, path string, text string"))
    assert rows_of(pages.broken_links(table)) == [("2026-01-01-x", 1), ("gone", 2), ("lost", 1)]
    assert rows_of(pages.mentioned_missing(table, 2)) == [("gone", 2)]
    assert rows_of(pages.orphans(table)) == [("index",), ("log",), ("one",)]
    assert rows_of(pages.index_drift(table)) == [("log", "not listed"), ("lost", "missing page"), ("one", "not listed")]
    assert rows_of(pages.sizes(table), "doc_id", "size") == [(1, "thin"), (2, "thin"), (3, "thin"), (4, "thin"), (5, "oversized")]
    assert [r for r in rows_of(pages.format_issues(table)) if r[0] == 1] == []
    assert (2, "heading of level one") in rows_of(pages.format_issues(table))
    assert rows_of(pages.log_entries(table)) == [(5, "2026-01-02", "ingest", "What it was")]
    assert rows_of(pages.sources_of(table)) == [(1, "2026-01-01-x")] and rows_of(pages.tag_counts(table)) == [("a", 1), ("b", 1)]


def test_records(spark, make):
    tree = json.dumps({"type": "Script", "commands": [{"type": "Command", "name": {"value": "find"}, "args": [{"type": "Command", "name": {"value": "grep"}}]}]})
    assert one(spark, records.tree_programs(F.lit(tree))) == ["find", "grep"]
    assert one(spark, records.discouraged(records.shell_programs(F.lit("ls | grep x && $(/bin/find .)")))) == ["find", "grep"]
    assert one(spark, records.warning(F.array(F.lit("grep")))) == "[warning] this command used 'grep'; prefer 'rg'"
    assert one(spark, records.swapped_commands(F.lit("find finding; grep"))) == "fd finding; rg"
    assert one(spark, records.clean_list(F.array(*map(F.lit, [" a", "", "b", "a "])))) == ["a", "b"]
    findings = make([("x", "P1", 80), ("x", "P3", 90), ("y", "P3", 100), ("y", "P2", 79)], "axis string, severity string, score int")
    assert rows_of(records.gated_findings(findings), "axis", "score") == [("x", 80), ("x", 90), ("y", 100)]
    assert rows_of(records.gated_findings(findings.withColumn("unambiguous", F.col("score") > 95)), "axis", "score") == [("x", 80), ("y", 100)]
    assert rows_of(records.relaxed(findings, [F.col("score") > 85, F.col("axis") == "z"], [F.desc("score")], 1), "score") == [(100,)]
    answers = records.labelled_answers(make([("q1", "v"), ("q2", "w")], "id string, value string"), make([("q1", "First")], "id string, label string"))
    assert rows_of(answers, "id", "label") == [("q1", "First"), ("q2", "q2")]
    assert [one(spark, records.verdict(F.lit(s))) for s in (8, 7, 4)] == ["good", "fair", "poor"]
    assert [one(spark, records.duration_class(F.lit(s))) for s in (299, 300, 1200, 1201)] == ["short", "medium", "medium", "long"]


def test_incremental_refresh(spark, tmp_path):
    from sparkloom.streaming import incremental

    source, folder = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    parse = lambda files: files.select("file_path", F.explode(F.split("text", "\n")).alias("symbol"))

    def refresh():
        incremental.follow_files(spark, str(source), folder, str(tmp_path / "state"), parse).awaitTermination(60)
        return sorted((r.file_path.rpartition("/")[2], r.symbol) for r in spark.read.parquet(folder).collect())

    (source / "a.py").write_text("one\ntwo")
    (source / "b.py").write_text("three")
    assert refresh() == [("a.py", "one"), ("a.py", "two"), ("b.py", "three")]
    (source / "c.py").write_text("four")
    assert len(refresh()) == 4
    (source / "a.py").write_text("one\nchanged")
    (source / "b.py").unlink()
    (source / "d.py").write_text("")
    assert refresh() == [("a.py", "changed"), ("a.py", "one"), ("c.py", "four")]
    assert refresh() == refresh()
    query = incremental.follow_files(spark, str(source), folder, str(tmp_path / "other"), parse, continuous=True)
    for name in ("c.py", "d.py"):
        (source / name).unlink()
    (source / "e.py").write_text("five")
    for _ in range(60):
        time.sleep(1)
        if sorted(r.symbol for r in spark.read.parquet(folder).collect()) == ["changed", "five", "one"]:
            break
    query.stop()
    assert sorted(r.symbol for r in spark.read.parquet(folder).collect()) == ["changed", "five", "one"]
    (source / "e.py").write_bytes(b"\xff")
    failing = incremental.follow_files(spark, str(source), folder, str(tmp_path / "third"), lambda files: files.select("missing"))
    with pytest.raises(Exception, match="missing"):
        failing.awaitTermination(60)
    assert "missing" in str(failing.exception())
    batch = spark.createDataFrame([(next(r.file_path for r in spark.read.parquet(folder).collect() if r.file_path.endswith("a.py")), "new")], "file_path string, symbol string")
    incremental.replace_files(batch, folder)
    assert sorted(r.symbol for r in spark.read.parquet(folder).collect()) == ["five", "new"]


def test_queries_have_sql_of_the_same_name():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


@pytest.mark.parametrize("piece", [1, 3, 50])
def test_merging_does_not_depend_on_pieces(make, piece):
    import random

    rng = random.Random(piece)
    cues = [(rng.choice([1, 1, 1, 2, None]), i, i * rng.choice([0.5, 1.0]), rng.choice(["so we go", "we go on", "on now.", "and then", "x"])) for i in range(120)]
    expected = []
    for doc in (1, 2, None):
        own = sorted(({"seconds": s, "seq": q, "text": t} for d, q, s, t in cues if d == doc), key=lambda c: (c["seconds"], c["seq"]))
        expected += [(doc, c["seq"], c["seconds"], c["text"]) for c in timed_text.merged(own)]
    table = make(cues, "doc_id int, seq int, seconds double, text string")
    assert rows_of(timed_text.merge_fragments(table, piece), "doc_id", "seq", "seconds", "text") == sorted(expected, key=repr)
    assert timed_text.merge_fragments(table.limit(0)).collect() == []


def test_empty_arguments_and_repeated_keys_of_logs(make):
    block = lambda **fields: {"type": "toolCall", "name": "bash"} | fields
    calls = [block(arguments=nothing, input={"command": "ls"}) for nothing in ([], {}, "", 0, False, None, 0.0)] + [block(arguments=[None], input={"command": "ls"}), block(arguments="x", input={"command": "ls"})]
    rows = [("p", 1, entry(content=calls)), ("p", 2, '{"type": "session", "type": "message", "message": {"role": "x", "role": "user"}}')]
    parsed = logs.entries(make([*rows, *rows], "path string, line_no bigint, line string"))
    found = logs.messages(parsed)
    assert [r.args is not None for r in logs.tool_calls(found).collect()] == [True] * 7 + [False] * 2
    assert rows_of(found, "line_no", "role") == [(1, None), (2, "user")]


def test_report_as_text(make):
    lines_of = make([("s/a.jsonl", i, line) for i, line in enumerate(LOG)], "path string, line_no bigint, line string")
    report = logs.report(lines_of)
    text = rows_of(logs.report_text(report, ("overview", "tools")), "section", "line_no", "line")
    assert ("overview", 4, "per session 15 tokens, $0.500") in text and ("tools", 1, "read 2 calls, 1 errors, 50.0%") in text
    assert {r[0] for r in text} == {"overview", "tools"}
    assert [name for name, _ in logs.chosen_sections(report, ("tools", "overview", "none"))] == ["overview", "tools"]


def test_templates_take_out_only_the_line_ends_of_empty_values(make):
    rows = make([("x\n\n\n\ny", None), ("", "b"), (None, None)], "a string, b string")
    filled = text.filled_template(F.lit("{{a}}\n\n{{b}}\n\n{{b}}"), {"a": F.col("a"), "b": F.col("b")})
    assert [r.t for r in rows.select(filled.alias("t")).collect()] == ["x\n\n\n\ny\n\n{{b}}", "b\n\n{{b}}", "{{b}}"]


def test_podcast_transcripts_start_at_zero(make):
    payload = '<tt xmlns="http://www.w3.org/ns/ttml"><body><p>first</p><p begin="0:05">second</p></body></tt>'
    files = make([(1, "ttml", payload)], "doc_id int, ext string, payload string")
    assert [(r.seconds, r.text) for r in subtitles.parse_subtitles(files, podcast=True)[0].collect()] == [(0.0, "first"), (5.0, "second")]
    assert [r.text for r in subtitles.parse_subtitles(files)[0].collect()] == ["second"]


def test_queries_and_episodes(make):
    typed = {"  @a/b \t": "a/b", "@@x": "@x", "x@": "x@", "": "", None: None}
    assert {r.v: r.q for r in texts(make, list(typed)).select("v", paths.query_form(F.col("v")).alias("q")).collect()} == typed
    sources = {"123": "123", "https://p.example/id1?i=45&l=x": "45", "https://p.example/id1?l=x&i=6": "6", "https://p.example/id1": None, "https://p.example/?i=": None, None: None}
    assert {r.v: r.e for r in texts(make, list(sources)).select("v", paths.episode_id(F.col("v")).alias("e")).collect()} == sources


def test_shown_with_counts(make):
    nodes = make([("c", "class", "C", "f", 1)] + [(f"m{i:02}", "method", f"m{i}", "f", 60 - i) for i in range(60)], "id string, kind string, name string, file_path string, start_line int")
    edges = make([("c", f"m{i:02}", "contains") for i in range(60)], "src string, dst string, kind string")
    shown = rows_of(graph.members_shown(nodes, edges), "rank", "id", "of")
    assert shown[0] == (1, "m59", 60) and len(shown) == 50 and len(graph.file_symbols(nodes).collect()) == 50
    reached = make([(f"n{i}", i % 3 + 1) for i in range(90)], "id string, depth int")
    by_depth = graph.shown_by_depth(reached).collect()
    assert len(by_depth) == 60 and {(r.depth, r.of) for r in by_depth} == {(1, 30), (2, 30)}


def test_hub_of_a_third_of_all_edges(make):
    edges = make([("hub", f"n{i}") for i in range(300)] + [(f"n{i}", f"m{i}") for i in range(300)], "src string, dst string")
    reached = graph.expand(edges, make([("hub",)], "id string"), 3, paths=False)
    assert rows_of(reached.groupBy("depth").count()) == [(0, 1), (1, 300), (2, 300)]


def test_nearest_holders(make):
    nodes = make([("p", "package", "p"), ("c", "class", "C"), ("m", "method", "m"), ("l", "variable", "l"), ("x", "function", "x")], "id string, kind string, name string")
    edges = make([("p", "c", "contains"), ("c", "m", "contains"), ("m", "l", "contains"), ("p", "x", "contains"), ("x", "p", "contains")], "src string, dst string, kind string")
    holders = graph.nearest_holders(nodes, edges)
    assert rows_of(holders, "id", "ancestor", "distance") == [("l", "c", 2), ("m", "c", 1)]
    full, near = (dict(rows_of(graph.display_names(nodes, chain))) for chain in (graph.ancestors(edges), holders))
    assert near == full and near["l"] == "C.l" and near["x"] == "x"
