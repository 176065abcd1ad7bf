"""Deduplication judges rows, not ids; tool calls survive any arguments."""

from __future__ import annotations

import json

import pytest

from framequarry.llm import near, simhash, tool_calls

A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
C = " ".join(f"c{i}" for i in range(40))
A2 = A + " more"
ROWS = [
    (3, A, 1), (7, A, 2), (7, B, 3),  # B is unlike anything else
    (5, C, 4), (5, C, 5), (5, C, 5), (None, C, 6), (None, C, 6), (9, C, 7),  # one of all stays
    (None, "only here", 8), (None, "only here", 8), (None, "another one with no id", 9),
    (11, "", 10), (12, None, 11), (12, " ", 12),
]


@pytest.mark.parametrize("module", [near, simhash])
def test_rows_are_judged_not_ids(spark, module):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, none int").repartition(3)
    got = sorted(((r.doc_id, r.text, r.none) for r in module.deduplicated(df).collect()), key=str)
    texts = [t for _, t, _ in got]
    assert sorted(t for t in texts if t and t.strip()) == sorted([A, B, C, "only here", "another one with no id"])  # no unique row goes, no copy stays
    assert [r[:2] for r in got if r[1] in (A, B)] == [(3, A), (7, B)]
    assert [r for r in got if r[1] == C][0][:2] == (5, C)
    assert sum(not (t or "").strip() for t in texts) == 1 and (11, "", 10) in got
    assert module.deduplicated(df.limit(0)).count() == 0


def test_near_copies_of_repeated_ids(spark):
    rows = [(1, A2, 1), (1, B, 2), (2, A, 3), (1, A, 4)]
    got = {(r.doc_id, r.text) for r in near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, winner int")).collect()}
    assert len(got) == 2 and (1, B) in got and not (2, A) in got


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
TREE: dict = {"type": "array"}
TREE["items"] = TREE


def test_arguments_of_any_depth(spark):
    depths = [1, 399, 400, 401, 2000, *range(9000, 10101, 7), 9996, 9997, 9998, 100000]
    calls = [(1, f"{k}-{i}", i, "f", o * d + c * d, None) for i, d in enumerate(depths) for k, (o, c) in enumerate([("[", "]"), ('{"a":', "}")]) if d < 99999 or k == 0]
    calls += [(2, "x", 0, "g", '"' + "[" * 20000 + '"', None)]
    schemas = {"f": {}, "g": {"type": [["string"], "string"]}}
    out = {(r.conv_id, r.call_id): r for r in tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert len(out) == len(calls)
    for c in calls[:-1]:
        deep = max(c[4].count("["), c[4].count("{")) > 400 or '{"a":}' in c[4]
        assert out[1, c[1]].errors == (["$: json"] if deep else []), c[1]
    assert out[2, "x"].valid
    deep = tool_calls.parsed("[" * 400 + "]" * 400)[0]
    assert tool_calls.violations(deep, TREE) == []


@pytest.mark.parametrize(
    ("text", "form", "errors"),
    [
        ('{"b": 1.0, "a": 1e2}', '{"a":100,"b":1}', []),
        ("-0.0", "0", []),
        ("1E400", None, ["$: json"]),
        ('{"a": 1, "a": 2, "b": {"c": 1, "c": 1}}', '{"a":2,"b":{"c":1}}', ["$: repeated key a", "$: repeated key c"]),
        ("0.1", "0.1", []),
        ("1e22", "10000000000000000000000", []),
        ('"\\ud800"', '"\\ud800"', []),
    ],
)
def test_canonical_forms(spark, text, form, errors):
    calls = spark.createDataFrame([(1, "c", 0, "f", text, None)], CALLS)
    row = tool_calls.linked(calls, spark.createDataFrame([], RESULTS), {"f": {}}).first()
    assert row.errors == errors
    arguments = row.message.split('"arguments":', 1)[1].split(',"name"', 1)[0]
    assert arguments == form if form is not None else json.loads(row.message)["call"]["function"]["arguments"] == text
