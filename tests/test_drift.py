from __future__ import annotations

import json
import random
from collections import defaultdict

from conftest import rows_of

from sparkloom.operators import drift

SCHEMA = "call_id bigint, client string, file_name string, row_no int, written_at timestamp_ntz, called_at timestamp_ntz, tool string, call_json string, loaded_at string"
KINDS = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}


def corpus(seed: int = 1) -> list[tuple]:
    """Files of clients whose argument names, types and optional fields change."""
    rng, rows, call = random.Random(seed), [], 0
    import datetime as dt

    for client in range(30):
        names, object_key, as_text, text_limit = rng.choice(["filePath", "file_path", "target"]), "arguments", False, False
        for file in range(8):
            if rng.random() < 0.4:
                names = rng.choice(["filePath", "file_path", "target"])
            if rng.random() < 0.3:
                object_key = rng.choice(["arguments", "input"])
            as_text, text_limit = rng.random() < 0.2, rng.random() < 0.2
            extras = [e for e in ("tags", "labels") if rng.random() < 0.3]
            for _ in range(4):
                call += 1
                args: dict = {names: f"src/a{call}.py", "limit": str(call) if text_limit else call}
                for extra in extras:
                    args[extra] = ["x"] if rng.random() < 0.8 else None
                body = {"type": "toolCall", "id": f"c{call}", "name": "read", object_key: json.dumps(args) if as_text else args}
                rows.append((call, f"c{client}", f"f{file}", call, dt.datetime(2026, 1, 1 + file), None, "read", json.dumps(body), "t"))
    return rows


def expected_log(rows: list[tuple]) -> set[tuple]:
    """The log by brute force, with the names of one argument given."""
    same = {n: "path" for n in ("filePath", "file_path", "target")}
    files: dict = defaultdict(dict)
    for _, client, file, _, written, _, tool, text, _ in rows:
        body = json.loads(text)
        key = "arguments" if "arguments" in body else "input"
        args = body[key]
        own = files[client, tool].setdefault((written, file), {"keys": {}, "whole": (key, "string" if isinstance(args, str) else "object")})
        for k, v in (json.loads(args) if isinstance(args, str) else args).items():
            own["keys"][k] = KINDS[type(v)] if v is not None else own["keys"].get(k)
    log = set()
    for (client, tool), by_time in files.items():
        ordered = sorted(by_time)
        for a, b in zip(ordered, ordered[1:]):
            old, new, at = by_time[a]["keys"], by_time[b]["keys"], (client, b[1], tool)
            gone, came = set(old) - set(new), set(new) - set(old)
            renamed = {(g, c) for g in gone for c in came if same.get(g) and same.get(g) == same.get(c)}
            log |= {(*at, g, c, "renamed") for g, c in renamed}
            log |= {(*at, "", c, "added") for c in came - {c for _, c in renamed}} | {(*at, g, "", "removed") for g in gone - {g for g, _ in renamed}}
            pairs = renamed | {(k, k) for k in set(old) & set(new)}
            log |= {(*at, g, c, "retyped") for g, c in pairs if old[g] and new[c] and old[g] != new[c]}
            (old_key, old_kind), (new_key, new_kind) = by_time[a]["whole"], by_time[b]["whole"]
            log |= {(*at, old_key, new_key, "renamed")} if old_key != new_key else set()
            log |= {(*at, old_key, new_key, "retyped")} if old_kind != new_kind else set()
    return log


def test_log_matches_brute_force(make):
    rows = corpus()
    calls = make([*rows, *rows[:50]], SCHEMA)
    got = rows_of(drift.drift_log(calls))
    assert len(got) == len(set(got))
    assert set(got) == expected_log(rows)


def test_union_schema_and_unified_calls(make):
    rows = corpus()
    calls = make(rows, SCHEMA)
    schema = {r.argument: r for r in drift.union_schema(calls).collect()}
    assert {tuple(r.names) for r in schema.values()} == {("filePath", "file_path", "target"), ("limit",), ("labels",), ("tags",)}
    assert schema["limit"].kind == "string" and schema["tags"].kind == "array"
    path = next(a for a, r in schema.items() if len(r.names) == 3)
    unified = drift.unified_calls(calls).collect()
    assert len(unified) == len(rows)
    assert all(r.args[path] == f"src/a{r.call_id}.py" and r.args["limit"] == str(r.call_id) for r in unified)


def test_the_lattice():
    def fold(*shown):
        whole = "VOID"
        for one in shown:
            whole = drift.joined(whole, drift.parse_type(one))
        return drift.column_type(whole)

    assert fold("BIGINT", "DECIMAL(3,1)") == "double" and fold("BIGINT", "VOID") == "bigint" and fold("BIGINT", "BOOLEAN") == "string"
    assert fold("ARRAY<BIGINT>", "ARRAY<DOUBLE>", "ARRAY<VOID>") == "array<double>" and fold("ARRAY<BIGINT>", "STRING") == "string"
    assert fold("OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>", "OBJECT<a: DECIMAL(2,1), `d e`: BOOLEAN>") == "struct<`a`:double,`b`:array<struct<`c`:string>>,`d e`:boolean>"
    assert fold("VOID") == "string" and fold("OBJECT<>") == "string" and fold("OBJECT<a: BIGINT, A: BIGINT>") == "string"


def one_tool(files, tool="read"):
    import datetime as dt

    rows = []
    for i, (client, calls) in enumerate(files):
        for args in calls:
            rows.append((len(rows), client, f"f{i}", len(rows), dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), None, tool, json.dumps({"arguments": args}), "t"))
    return rows


def test_a_change_tells_a_rename_by_itself(make):
    rows = one_tool([("c", [{"path": "a/b.py", "oldText": "some words", "newText": "more words", "limit": 5}] * 3), ("c", [{"target": "c/d.py", "search": "any words", "replacement": "new words", "max": "7"}] * 3)])
    got = {(r.old_field, r.new_field, r.change) for r in drift.drift_log(make(rows, SCHEMA)).collect()}
    assert got == {("path", "target", "renamed"), ("oldText", "search", "renamed"), ("newText", "replacement", "renamed"), ("limit", "max", "renamed"), ("limit", "max", "retyped")}


def test_names_that_stand_together_are_two_arguments(make):
    rows = one_tool([("c", [{"limit": 5}]), ("c", [{"retry": 7}]), ("d", [{"limit": 1, "retry": 2}])])
    got = {(r.client, r.old_field, r.new_field, r.change) for r in drift.drift_log(make(rows, SCHEMA)).collect()}
    assert got == {("c", "limit", "", "removed"), ("c", "", "retry", "added")}


def test_calls_are_cast_to_the_union_schema(make):
    rows = one_tool([("c", [{"n": 1, "at": {"x": 1}, "tags": ["a"]}, {"n": None}]), ("c", [{"n": 2.5, "at": {"x": 2, "y": "z"}, "tags": [1]}]), ("d", [{"N": 3, "n": 4, "flag": True}])])
    unified = drift.unified_calls(make([*rows, *rows], SCHEMA)).orderBy("call_id")
    types = {f.name: f.dataType.simpleString() for f in unified.schema["args"].dataType}
    assert types == {"N": "bigint", "at": "struct<x:bigint,y:string>", "flag": "boolean", "n": "double", "tags": "array<string>"}
    args = [r.args for r in unified.collect()]
    assert [a["n"] for a in args] == [1.0, None, 2.5, 4.0] and [a["tags"] for a in args] == [["a"], None, ["1"], None] and tuple(args[2]["at"]) == (2, "z")


def test_other_names_of_one_call_are_kept(make):
    rows = one_tool([("c", [{"filePath": "a/b"}] * 3), ("c", [{"file_path": "c/d"}] * 3), *[(f"e{i}", [{"filePath": "a/b"}]) for i in range(300)], *[(f"g{i}", [{"file_path": "a/b"}]) for i in range(300)], ("d", [{"filePath": "x/y", "file_path": "z/w"}])])
    (last,) = [r for r in drift.unified_calls(make(rows, SCHEMA)).collect() if r.client == "d"]
    assert last.args["filePath"] == "x/y" and last.more == {"file_path": "z/w"}


def test_long_chains_of_names_are_one_argument(make):
    rows = one_tool([("c", [{f"name{i}": "a/b"}]) for i in range(12)])
    (schema,) = drift.union_schema(make(rows, SCHEMA)).collect()
    assert len(schema.names) == 12 and schema.n_files == 12


def test_odd_calls(make):
    import datetime as dt

    def row(call, client, tool, text):
        return (call, client, f"f{call}", 1, dt.datetime(2026, 1, call), None, tool, text, "t")

    texts = ['{"arguments": {"a": 1}}', "broken", '{"arguments": null}', '{"arguments": "text"}', '{"arguments": {}}', '{"arguments": {"a": null}}', '{"arguments": {"a": "x"}}', None]
    rows = [row(i + 1, None, None, t) for i, t in enumerate(texts)]
    log = rows_of(drift.drift_log(make(rows, SCHEMA)))
    assert (None, "f3", None, "a", "", "removed") in log and (None, "f5", None, "arguments", "arguments", "retyped") in log
    assert (None, "f6", None, "", "a", "added") in log and not any(r[1] == "f7" and r[5] == "retyped" for r in log)
    assert len(drift.unified_calls(make(rows, SCHEMA)).collect()) == len(rows)
    assert drift.drift_log(make([], SCHEMA)).collect() == [] and drift.unified_calls(make([], SCHEMA)).collect() == []
    twice = row(9, "r", "t", '{"arguments": {"a": 1, "a": "x"}}')
    assert [r.args["a"] for r in drift.unified_calls(make([twice], SCHEMA)).collect()] == ["x"]
