import json

import pytest

from corpusloom.llm import tool_calls as T

CALLS = "conv_id long, turn long, place int, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, place int, call_id string, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]}}, "additionalProperties": False}}


@pytest.mark.parametrize(
    ("value", "schema", "want"),
    [
        ({"a": 1}, SCHEMAS["add"], []), ({}, SCHEMAS["add"], ["arguments.a: missing"]), ({"a": "1"}, SCHEMAS["add"], ["arguments.a: not integer"]), ({"a": True}, SCHEMAS["add"], ["arguments.a: not integer"]),
        ({"a": -1, "c": 2}, SCHEMAS["add"], ["arguments.a: below minimum", "arguments.c: unknown"]), ({"a": {"$ref": "x"}}, SCHEMAS["add"], []), ({"a": 1, "b": None}, SCHEMAS["add"], []),
        ([1, "x"], {"type": "array", "items": {"type": "number"}, "maxItems": 1}, ["arguments: too many", "arguments[1]: not number"]),
        ("abc", {"type": "string", "pattern": "^b", "maxLength": 2}, ["arguments: too long", "arguments: pattern"]), ("x", {"enum": ["y"]}, ["arguments: not in enum"]), (3.0, {"type": "integer"}, []), (1, {"const": 1.5}, ["arguments: not the constant"]),
    ],
)
def test_schemas(value, schema, want):
    assert T.violations(value, schema) == want


def test_canonical_json():
    assert T.canonical({"b": [1, 2.5, None], "a": {"é": "x\n"}}) == '{"a":{"é":"x\\n"},"b":[1,2.5,null]}'
    with pytest.raises(ValueError):
        T.canonical(float("nan"))


def ref(x):
    return json.dumps({"a": {"$ref": x}})


def test_linking_and_order(spark):
    calls = [
        (1, 5, 0, "c", "add", ref("b")), (1, 1, 0, "b", "add", ref("a")), (1, 2, 0, "a", "add", '{"a": 1}'), (1, 3, 0, "a", "add", '{"a": 2}'), (1, 4, 0, "x", "add", ref("y")), (1, 4, 1, "y", "add", ref("x")),
        (1, 6, 0, "z", "add", ref("nowhere")), (1, 7, 0, None, "other", "{broken"), (2, 0, 0, "a", "unknown", "{}"), (None, 0, 0, "a", "add", '{"a": 3}'),
    ]
    results = [(1, 9, 1, "a", '"later"'), (1, 9, 0, "a", '"sooner"'), (1, 9, 2, "b", "1"), (1, 9, 3, "ghost", "2"), (2, 1, 0, None, "3"), (2, 1, 1, "a", "4")]
    got = T.link(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["position"] for r in one] == list(range(12))
    by = {(r["call_id"], r["turn"]): r for r in one if r["status"] != "result"}
    assert by["a", 2]["status"] == "linked" and by["a", 2]["n_results"] == 2
    behind = [r for r in one if r["status"] == "result" and r["call_id"] == "a"]
    assert [json.loads(r["message"])["content"] for r in behind] == ["sooner", "later"] and [r["position"] for r in behind] == [by["a", 2]["position"] + k for k in (1, 2)]
    assert [(r["level"], r["name"]) for r in behind] == [(0, "add")] * 2
    assert by["a", 3]["status"] == "duplicate_call" and by["b", 1]["status"] == "linked" and by["c", 5]["status"] == "no_result"
    assert by["x", 4]["status"] == by["y", 4]["status"] == "cycle" and by["z", 6]["status"] == "missing_ref" and by["ghost", 9]["status"] == "no_call"
    assert by["a", 2]["position"] < by["b", 1]["position"] < by["c", 5]["position"] and [by[k, t]["level"] for k, t in (("a", 2), ("b", 1), ("c", 5))] == [0, 1, 2]
    assert by[None, 7]["valid"] is False and by[None, 7]["errors"] == "arguments: not JSON" and by[None, 7]["status"] == "no_result"
    two = {(r["call_id"], r["status"]): r for r in got if r["conv_id"] == 2}
    assert two["a", "linked"]["valid"] is None and (None, "no_call") in two
    (three,) = [r for r in got if r["conv_id"] is None]
    assert three["status"] == "no_result" and three["level"] is None and three["valid"]
    assert len(got) == len(calls) + len(results)


def test_blocks_in_texts(spark):
    call = lambda i, args: f'<tool_call>{json.dumps({"id": i, "name": "add", "arguments": args})}</tool_call>'
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "so " + call("t1", {"a": 1}) + call("t2", {"a": {"$ref": "t1"}}) + "<tool_call>{oops</tool_call>"),
        (1, 2, "tool", '<tool_response>{"id": "t1", "content": {"v": 2}}</tool_response>'), (1, 3, "assistant", None),
    ]
    got = T.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    by = {r["call_id"]: r for r in got if r["call_id"] and r["status"] != "result"}
    (heard,) = [r for r in got if r["call_id"] == "t1" and r["status"] == "result"]
    assert heard["message"] == '{"content":{"v":2},"id":"t1","name":"add"}'
    assert by["t1"]["message"] == '{"arguments":{"a":1},"id":"t1","name":"add"}' and by["t2"]["level"] == 1 and by["t2"]["status"] == "no_result"
    assert by["c1-0"]["status"] == "linked" and by["c1-2"]["status"] == "no_call"


def test_identifiers_that_are_no_strings(spark):
    call = lambda i, args: f'<tool_call>{json.dumps({"id": i, "name": "add", "arguments": args})}</tool_call>'
    rows = [
        (1, 0, "assistant", call(7, {"a": 1}) + call(8, {"a": {"$ref": 7}}) + call(float("nan"), {"a": 1}) + call(None, {"a": {"$ref": None}})),
        (1, 1, "tool", "".join(f'<tool_response>{{"id": {i}, "content": 2}}</tool_response>' for i in ("7", "8", "null"))),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = T.link(T.parse_calls(frame), T.parse_results(frame), SCHEMAS).collect()
    assert sorted((r["call_id"] or "", r["status"], r["level"] or 0) for r in got) == [("", "no_call", 0), ("", "no_result", 0), ("", "no_result", 0), ("7", "linked", 0), ("7", "result", 0), ("8", "linked", 1), ("8", "result", 1)]
    assert all(r["valid"] for r in got if r["call_id"] and r["status"] == "linked")


def test_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string, level string, position string, canonical string"
    rows = [(None, None, None, None, "x", "y", "z"), (3, 0, "system", "s", "x", "y", "z"), (3, 1, "user", "", "x", "y", "z"), (3, 1, "user", "", "x", "y", "z"), (3, 2, "assistant", "a" * 300_000, "x", "y", "z")]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r["call_id"], r["status"], r["valid"] is not False) for r in T.link_conversations(frame).collect())
    assert got[0] == ("c3-0", "no_result", True) and [x[1] for x in got[1:]] == ["linked", "linked", "result"] and len(got) == 4
    assert T.link_conversations(frame.limit(0)).count() == 0


DEEP = "[" * 5000 + "]" * 5000


@pytest.mark.parametrize("text", ['{"v":NaN}', '{"v":-Infinity}', '{"v":1e999}', '"\\ud800"', '{"\\udfff":1}', "[" * 200_000, None, "", "{", "1" * 5000])
def test_texts_that_are_no_json(text):
    assert T._json(text) == (None, None)


def test_deep_values_are_checked_without_recursion():
    value, schema = [], {"type": "array"}
    for _ in range(20_000):
        value, schema = [value], {"type": "array", "items": schema}
    assert T.violations(value, schema) == []
    (wrong,) = T.violations([value], {**schema, "items": {"type": "array", "items": schema}})[:1] or ["none"]
    assert wrong == "none" or wrong.startswith("arguments")


def test_odd_blocks_and_large_ids(spark):
    odd = ['{"v":NaN}', '"\\ud800"', DEEP, '{"a": 1e999}', '{"a": 1}']
    schemas = {"add": {"type": "array", "items": {"type": "array"}}}
    calls = [(2**60 + 1, 2**53 + 1, k, f"c{k}", "add", x) for k, x in enumerate(odd)] + [(None, None, 0, "c", None, None)]
    results = [(2**60 + 1, None, 0, "c4", '{"v": NaN}'), (None, 1, 0, "c", "1")]
    got = T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got if r["status"] not in ("result", "no_call")}
    assert len(got) == len(calls) + len(results) and {r["conv_id"] for r in got} == {2**60 + 1, None} and by[2**60 + 1, "c0"]["turn"] == 2**53 + 1
    assert all(by[2**60 + 1, f"c{k}"]["errors"] == "arguments: not JSON" for k in (0, 1, 3)) and by[2**60 + 1, "c4"]["errors"] == "arguments: not array"
    assert by[2**60 + 1, "c2"]["errors"] in ("", "arguments: not JSON") and by[None, "c"]["status"] == "no_result"
    (heard,) = [r for r in got if r["status"] == "result"]
    assert heard["turn"] is None and heard["message"] == '{"content":null,"id":"c4","name":"add"}'
    text = "".join(f'<tool_call>{{"id": "{k}", "name": "add", "arguments": {x}}}</tool_call>' for k, x in enumerate(odd))
    rows = [(2**60 + 1, 1, "assistant", text), (None, None, "assistant", text), (2**60 + 1, 2, "tool", '<tool_response>{"id": "4", "content": "\\ud800"}</tool_response>')]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in T.link_conversations(frame, schemas).collect()} == {2**60 + 1, None}


def test_a_hot_identifier_and_a_chain(spark):
    n = 300
    calls = [(1, k, 0, str(k), "add", ref(str(k - 1)) if 0 < k < 6 else '{"a": 1}') for k in range(40)]
    results = [(1, 100 + k, 0, "3", str(k)) for k in range(n)]
    got = T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS).repartition(5), SCHEMAS).collect()
    got.sort(key=lambda r: r["position"])
    at = next(k for k, r in enumerate(got) if r["call_id"] == "3")
    assert got[at]["n_results"] == n and [json.loads(r["message"])["content"] for r in got[at + 1 : at + 1 + n]] == list(range(n))
    assert {r["call_id"]: r["level"] for r in got} == {str(k): k if k < 6 else 0 for k in range(40)}
