import json

from larkspur.llm.chat import canonical, depths, format_calls, format_conversations, validate

CALLS = "conv_id long, call_id string, name string, arguments string, after string, result int, json string"
RESULTS = "conv_id long, call_id string, result string, name string"
SCHEMA = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"type": "array", "items": {"type": "string", "maxLength": 2}}}}}


def test_validate():
    check = lambda v: validate(v, SCHEMA["f"])
    assert check({"x": 1}) == [] and check({"x": 2.0, "y": ["ab"]}) == []
    assert check({}) == ["$.x: missing"] and check({"x": True}) == ["$.x: not integer"] and check([]) == ["$: not object"]
    assert check({"x": 0, "z": 1, "y": ["abc", 1]}) == ["$.z: unknown", "$.x: too small", "$.y[0]: too long", "$.y[1]: not string"]
    assert canonical({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'


def test_link_order_and_serialise(spark):
    long = 300
    calls = [(1, f"c{i}", "f", json.dumps({"x": i + 1}), f"c{i - 1}" if i else None, 0, "") for i in range(long)]
    calls += [(2, "a", "f", '{"x": 1}', "b", 0, ""), (2, "b", "f", '{"x": 1}', "a", 0, ""), (2, "c", "g", "{}", "unknown", 0, ""), (2, "d", "f", "{x", None, 0, "")]
    calls += [(3, "r", "f", None, None, 0, ""), (3, "r", "f", '{"x": NaN}', None, 0, ""), (None, "n", "f", "{}", None, 0, ""), (4, None, None, None, None, 0, "")]
    results = [(1, f"c{i}", f"r{i}", "x") for i in range(long)] + [(2, "a", "one", "x"), (2, "a", "two", "x"), (None, "n", "lost", "x"), (9, "z", "lost", "x")]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    out = format_calls(c, r, SCHEMA).collect()
    assert len(out) == len(calls)
    by = {(x.conv_id, x.call_id): x for x in out}
    assert all((by[1, f"c{i}"].depth, by[1, f"c{i}"].result, by[1, f"c{i}"].status, by[1, f"c{i}"].valid) == (i, f"r{i}", "ok", True) for i in range(long))
    assert by[1, "c0"].json == '{"arguments":{"x":1},"depth":0,"id":"c0","name":"f","result":"r0","status":"ok"}'
    assert by[2, "a"].depth is None and by[2, "a"].status == "ambiguous" and by[2, "a"].result == "one"
    assert by[2, "c"].depth == 0 and by[2, "c"].errors == ["$: no schema"] and by[2, "c"].status == "no result"
    assert by[2, "d"].errors == ["$: not JSON"]
    assert [x.status for x in out if x.conv_id == 3] == ["ambiguous"] * 2 and not any(x.valid for x in out if x.conv_id == 3)
    assert by[None, "n"].result is None and by[None, "n"].depth is None
    assert format_calls(c.limit(0), r.limit(0), SCHEMA).count() == 0 and depths(c.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "system", "be brief", 0), (1, 1, "user", "hi \"you\"", 0), (1, 2, "assistant", "hello", 0), (1, 3, "user", "more", 0), (2, 0, "user", None, 0), (2, 1, "assistant", None, 0), (None, 0, "user", "x", 0), (3, None, "user", "x", 0)]
    out = {(r.conv_id, r.call_id): r for r in format_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")).collect()}
    assert set(out) == {(1, "t1"), (1, "t3"), (2, "t0")}
    assert out[1, "t1"].json == '{"arguments":{"prompt":"hi \\"you\\"","system":"be brief","turn":1},"depth":0,"id":"t1","name":"reply","result":"hello","status":"ok"}'
    assert (out[1, "t3"].depth, out[1, "t3"].status) == (1, "no result") and out[2, "t0"].errors == ["$.prompt: missing"]
