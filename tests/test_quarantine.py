from __future__ import annotations

import json

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions.json_text import BROKEN, parse_strict
from sparkloom.operators import quarantine

SESSION = "path string, line_no bigint, line string, loaded_at string"


def message(**fields) -> str:
    return json.dumps({"type": "message", "message": {"role": "user"} | fields})


SESSION_CASES = {
    '{"type": "session"}': None,
    ' {"type":"custom"}\r': None,
    "": None,
    " \t\r": None,
    message(content="x"): None,
    message(content=None, usage=None): None,
    message(content=["a", {"type": "text"}], isError=None): None,
    message(usage={"input": 0, "output": None, "cost": {"total": 0.5}}): None,
    message(usage={"cost": {"total": None}}): None,
    message(usage={"input": 10**40}): None,
    "{'type': 'session'}": "syntax",
    '{"type": "session"} x': "syntax",
    '{"type": "session",}': "syntax",
    '{"type": NaN}': "syntax",
    '﻿{"type": "session"}': "syntax",
    '{"type": "a\tb"}': "syntax",
    '{"type": "session"': "syntax",
    '{"n": 01}': "syntax",
    " {}": "syntax",
    "[1]": "shape",
    "null": "shape",
    '"session"': "shape",
    "12": "shape",
    "{}": "value",
    '{"type": "Session"}': "value",
    '{"type": null}': "value",
    '{"type": 5}': "value",
    '{"type": "message"}': "value",
    '{"type": "message", "message": "x"}': "value",
    '{"type": "message", "message": {"role": 1}}': "value",
    message(content=5): "value",
    message(content={"a": 1}): "value",
    message(content=["a", 1]): "value",
    message(content=["a", None]): "value",
    message(content=[["a"]]): "value",
    message(isError="true"): "value",
    message(isError=0): "value",
    message(usage=[]): "value",
    message(usage={"input": -1}): "value",
    message(usage={"input": 1.0}): "value",
    message(usage={"input": True}): "value",
    message(usage={"input": "1"}): "value",
    message(usage={"cost": 1}): "value",
    message(usage={"cost": {"total": -0.1}}): "value",
    message(usage={"cost": {"total": "1"}}): "value",
    message(usage={"cost": {"total": True}}): "value",
}


def test_session_lines(make):
    lines = make([("p", i, line, "t") for i, line in enumerate(SESSION_CASES)] + [("p", 1000, None, "t")], SESSION)
    found = quarantine.failing_lines(lines, lines.limit(0))
    expected = {i: reason for i, reason in enumerate(SESSION_CASES.values()) if reason}
    assert {r.line_no: r.reason for r in found.collect()} == expected
    sound = quarantine.session_entries(lines)
    assert sound.count() == sum(not r and bool(line.strip()) for line, r in SESSION_CASES.items())


EXPORT_HEADER = "entry_id,type,timestamp,role,message"
EXPORT_CASES = {
    "1,message,2026-01-01T10:00:00Z,user,hi": None,
    '"2","message","","","a ""b"", c"': None,
    '3,custom,2026-02-28T23:59:59.123+05:30,,""': None,
    '4,session,,"",': None,
    '5,session,,,""""': None,
    "6,session,,,x\r": None,
    "  ": None,
    '7,message,,user,"open': "quoting",
    '8,message,,user,"a" b': "quoting",
    '9,message,,user,a "b" c': "quoting",
    '10,message,,user,a"': "quoting",
    '11,message,,"user"x,"a"': "quoting",
    '12,"message,,user,a': "quoting",
    "13,message,,user": "column_count",
    "14,message,,user,a,b": "column_count",
    "x,message": "column_count",
    "a15,message,,user,a": "value",
    ",message,,user,a": "value",
    "16,Message,,user,a": "value",
    "17,message,yesterday,user,a": "value",
    "18,message,2026-02-30T10:00:00Z,user,a": "value",
    "19,message,2026-02-03T10:00:00,user,a": "value",
    "20,message,2026-02-03T25:00:00Z,user,a": "value",
    EXPORT_HEADER: "value",
}


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
def test_export_lines(make, delimiter):
    lines = [EXPORT_HEADER, *EXPORT_CASES]
    rows = [("p", i, line.replace(",", delimiter), "t") for i, line in enumerate(lines, 1)]
    if delimiter == "\t":
        rows = [r for r in rows if r[2].strip()]
    table = make([*rows, *rows[:4]], SESSION)
    found = quarantine.failing_lines(table.limit(0), table)
    expected = {i: reason for i, reason in enumerate(EXPORT_CASES.values(), 2) if reason}
    assert {r.line_no: r.reason for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_empty_tables_and_odd_columns(make):
    empty = make([], SESSION + ", type string, errors string, fields string, e string")
    assert quarantine.failing_lines(empty, empty).collect() == []
    assert quarantine.export_entries(empty).collect() == []
    odd = make([("p", 2, "x", "t", "a", "b", "c", "d")], SESSION + ", type string, errors string, fields string, e string")
    assert rows_of(quarantine.failing_lines(odd, odd)) == [("p", 2, "column_count"), ("p", 2, "syntax")]


def test_very_long_fields(make):
    quotes = '""' * 50_000
    rows = [("p", 1, EXPORT_HEADER, "t"), ("p", 2, f'1,message,,user,"{quotes}"', "t"), ("p", 3, "[" * 3000 + "]" * 3000, "t")]
    table = make(rows, SESSION)
    assert quarantine.failing_lines(table.limit(0), table.filter("line_no < 3")).collect() == []
    assert [r.reason for r in quarantine.failing_lines(table.filter("line_no = 3"), table.limit(0)).collect()] in (["shape"], ["syntax"])


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8))
def test_strict_parser_reads_what_json_writes(value):
    assert parse_strict(json.dumps(value)) is not BROKEN
    assert parse_strict(json.dumps(value, ensure_ascii=False) + " ]") is BROKEN


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=12), st.integers(0, 60), st.sampled_from("[]{},:\"0 x\\"))
def test_deep_parser_agrees_with_the_decoder(value, at, mark):
    from sparkloom.functions.json_text import _parse_deep

    text = json.dumps(value, ensure_ascii=False, indent=at % 3 or None)
    changed = text[:at] + mark + text[at + 1 :]
    for t in (text, changed, text[:at], text + mark):
        assert _parse_deep(t) == parse_strict(t), t


def test_json_of_any_depth(make):
    depth = 60_000
    nested = '{"type": "custom", "x": ' + "[" * depth + '{"a": 1}' + "]" * depth + "}"
    table = make([("p", 1, nested), ("p", 2, nested[:-2] + "}"), ("p", 3, "[" * depth + "]" * depth)], "path string, line_no bigint, line string")
    reasons = quarantine.check_session_lines(table).select("line_no", "errors").collect()
    assert {r.line_no: list(r.errors) for r in reasons} == {1: [], 2: ["syntax"], 3: ["shape"]}
