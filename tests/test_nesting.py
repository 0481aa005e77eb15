from __future__ import annotations

import json

from conftest import rows_of

from sparkloom.operators import nesting

SCHEMA = "path string, line_no bigint, line string, loaded_at string, kind string, element string"


def lines(make, *messages):
    return make([("p", i, m if isinstance(m, str) else json.dumps({"type": "message", "message": {"role": "user"} | m}), "t", "x", "y") for i, m in enumerate(messages, 1)], SCHEMA)


def brute(message: dict) -> set[tuple[str, str]]:
    found = set()

    def visit(value, address, parent, in_content):
        if isinstance(value, dict):
            if in_content and value.get("type") == "toolCall":
                key = "arguments" if value.get("arguments") is not None else "input"
                value = {("args" if k == key else k): v for k, v in value.items()}
                if isinstance(value.get("args"), str):
                    try:
                        read = json.loads(value["args"])
                        value["args"] = read if isinstance(read, dict) else value["args"]
                    except ValueError:
                        pass
            for k, v in value.items():
                at = f"{address}.{k}" if address else k
                if isinstance(v, dict):
                    found.add((parent, at))
                    visit(v, at, at, False)
                elif isinstance(v, list):
                    visit(v, at, parent, False)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                at = f"{address}[{i}]"
                if v is not None:
                    found.add((parent, at))
                    visit(v, at, at, address == "content")

    visit(message, "", "message", False)
    return found


MESSAGES = [
    {},
    {"content": "text", "usage": {"input": 1, "cost": {"total": 1, "parts": [1, {"a": {}}, None, [2, [3]]]}}},
    {"content": ["a", {"type": "text", "text": "x"}, {"type": "toolCall", "name": "edit", "arguments": {"path": "p", "edits": [{"old": "a"}, {"old": "b", "at": [1, 2]}]}}]},
    {"content": [{"type": "toolCall", "input": '{"a": {"b": [1]}}'}, {"type": "toolCall", "arguments": "[1]"}, {"type": "toolCall", "arguments": "no json {"}, {"type": "text", "arguments": {"x": {}}}]},
    {"content": [{"type": "toolCall", "arguments": None, "input": {"a": {}}}], "details": {"hits": [{"file": "f"}]}},
    {"other": {"content": [{"type": "toolCall", "arguments": {"x": 1}}]}},
]


def test_child_records_match_brute_force(make):
    table = lines(make, *MESSAGES)
    table = table.unionAll(table.limit(3))
    got = rows_of(nesting.child_records(table, False), "line_no", "parent", "node")
    expected = sorted(((i, *pair) for i, m in enumerate(MESSAGES, 1) for pair in brute({"role": "user"} | m)), key=repr)
    assert got == expected


def test_links_of_tables_match_brute_force(make):
    table = lines(make, *MESSAGES)
    records = nesting.read_records(table.unionAll(table.limit(3)), False)
    tables = nesting.flat_tables(records, nesting.schema_graph(records))
    expected = sorted(((i, *pair) for i, m in enumerate(MESSAGES, 1) for pair in brute({"role": "user"} | m)), key=repr)
    assert rows_of(nesting.table_links(tables), "line_no", "parent", "node") == expected


def test_failing_blank_and_other_lines_have_no_rows(make):
    table = lines(make, "", "broken {", '{"type": "session", "message": {"a": {}}}', '{"type": "message", "message": {"role": 1, "a": {}}}')
    records = nesting.read_records(table)
    assert nesting.child_records(table).collect() == [] and nesting.schema_graph(records).collect() == []
    assert nesting.flat_tables(records, nesting.schema_graph(records)).collect() == []


def test_tables_by_shared_inlining(make):
    message = {"usage": {"input": 5, "cost": {"total": 0.5}}, "content": [{"type": "text", "text": "x"}], "tree": {"name": "r", "tree": {"name": "s"}}, "a": {"owner": {"id": 1}}, "b": {"owner": {"id": 2}}}
    records = nesting.read_records(lines(make, message))
    graph = {r.element: r for r in nesting.schema_graph(records).collect()}
    assert not graph["usage"].own_table and (graph["cost"].table_name, graph["cost"].up) == ("message", 2)
    assert graph["content"].repeated and graph["content"].own_table
    assert graph["tree"].recursive and graph["owner"].shared and graph["owner"].table_name == "owner" and not graph["a"].own_table
    tables = nesting.flat_tables(records, nesting.schema_graph(records))
    flat = nesting.flat_table(tables, "message", {"role": "string", "usage.input": "bigint", "usage.cost.total": "double"})
    assert [(r.role, r.usage_input, r.usage_cost_total) for r in flat.collect()] == [("user", 5, 0.5)]
    assert rows_of(nesting.flat_table(tables, "content", {"text": "string"}), "node", "parent", "text") == [("content[0]", "message", "x")]
    assert rows_of(nesting.flat_table(tables, "owner", {"id": "int"}), "node", "parent", "id") == [("a.owner", "a", 1), ("b.owner", "b", 2)]
    assert rows_of(nesting.flat_table(tables, "tree", {"name": "string"}), "node", "parent", "name") == [("tree", "message", "r"), ("tree.tree", "tree", "s")]


def test_shared_and_recursive_elements_have_one_table(make):
    block = {"meta": {"loc": {"n": 1}}, "other": {"loc": {"n": 2}}}
    messages = [{"content": [block]}, {"kids": [{"n": 1, "kids": [{"n": 2, "kids": [{"n": 3}]}]}]}, {"x": {"y": {"x": {"n": 4}}}}]
    records = nesting.read_records(lines(make, *messages))
    tables = nesting.flat_tables(records, nesting.schema_graph(records))
    of = lambda name: rows_of(nesting.flat_table(tables, name, {"n": "int"}), "parent", "node", "n")
    assert of("loc") == [("content[0].meta", "content[0].meta.loc", 1), ("content[0].other", "content[0].other.loc", 2)]
    assert of("kids") == [("kids[0]", "kids[0].kids[0]", 2), ("kids[0].kids[0]", "kids[0].kids[0].kids[0]", 3), ("message", "kids[0]", 1)]
    assert of("x") == [("message", "x", None), ("x.y", "x.y.x", 4)]


def test_hostile_keys(make):
    message = {"a.b": {"c": 1, "d.e": 2}, "a": {"b": {"c": 3}}, "message": {"message": {"n": 4}}, "": {"": [{"": 5}]}, 'q"': {'"': 6}, "[0]": [[{}]]}
    records = nesting.read_records(lines(make, message))
    tables = nesting.flat_tables(records, nesting.schema_graph(records)).collect()
    assert {r.table_name for r in tables} >= {"message", "message~", ""}
    root = next(r for r in tables if r.parent is None)
    assert root.fields['a.b."d.e"'] == "2" and root.fields["a.b.c"] in ("1", "3")


def test_deep_records_do_not_overflow(make):
    depth = 900
    message = {"a": json.loads('{"a":' * depth + "1" + "}" * depth)}
    records = nesting.read_records(lines(make, message), False)
    graph = nesting.schema_graph(records)
    assert nesting.child_records(lines(make, message), False).count() == depth
    assert nesting.table_links(nesting.flat_tables(records, graph)).count() == depth
    assert {r.table_name for r in graph.collect()} == {"message", "a"}


def test_long_chains_of_single_elements_are_inlined(make):
    message: dict = {"n": 1}
    for i in range(40):
        message = {f"k{i}": message}
    records = nesting.read_records(lines(make, message))
    graph = nesting.schema_graph(records)
    assert {r.table_name for r in graph.collect()} == {"message"} and graph.agg({"up": "max"}).first()[0] == 40
    (row,) = nesting.flat_tables(records, graph).collect()
    assert row.fields[".".join(f"k{i}" for i in reversed(range(40))) + ".n"] == "1" and len(row.inlined) == 40
