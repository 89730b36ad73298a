import json

from colloquy.llm.tool_calls import link_tool_calls, tool_items

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "ping": {}}


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def result(call_id, content="ok"):
    return json.dumps({"tool_call_id": call_id, "content": content})


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", call({"id": "x", "name": "add", "arguments": {"b": 1.5, "a": 2}}, {"name": "add", "id": "y", "arguments": {"a": "2", "c": 1}, "after": ["z"]})),
    (1, 2, "tool", result("x")),
    (1, 3, "tool", result("y")),
    (1, 4, "assistant", call({"id": "z", "name": "ping", "arguments": {}})),
    (1, 5, "tool", result("z", {"b": [1, None], "a": "é"})),
    (1, 6, "tool", result("nobody")),
    (2, 0, "assistant", call({"id": "p", "name": "ping", "arguments": [1], "after": ["q"]}, {"id": "q", "name": "who", "after": ["p"]}, {"id": "p", "name": "ping", "arguments": {}})),
    (2, 1, "assistant", "{broken"),
    (2, 2, "tool", None),
    (3, 0, None, ""),
    (None, 0, "assistant", call({"id": "x", "name": "ping", "arguments": {}})),
    (4, 0, "assistant", call({"id": "a", "name": "add", "arguments": {"a": None, "b": True}, "after": ["gone", "a2"]})),
]


def table(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "'k' AS kind")


def test_links_errors_order_and_json(spark):
    rows = link_tool_calls(tool_items(table(spark), SCHEMAS)).collect()
    assert len(rows) == 16
    by = {(r["conv_id"], r["turn"], r["pos"]): r for r in rows}
    x, y, z = by[1, 1, 0], by[1, 1, 1], by[1, 4, 0]
    assert x["linked"] and x["errors"] == [] and x["json"] == '{"arguments":{"a":2,"b":1.5},"id":"x","name":"add"}'
    assert y["errors"] == ["a is not integer", "missing b", "unknown c"]
    # y waits for z: it stands behind z's result, and its own result behind it
    order = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: (r["after_turn"], r["depth"], r["turn"], r["pos"]))
    ids = [(r["kind"], r["id"]) for r in order]
    assert ids.index(("call", "z")) < ids.index(("result", "z")) < ids.index(("call", "y")) < ids.index(("result", "y"))
    assert z["errors"] == [] and z["linked"]
    assert by[1, 5, 0]["json"] == '{"content":{"a":"é","b":[1,null]},"tool_call_id":"z"}'
    assert by[1, 6, 0]["linked"] is False and by[1, 6, 0]["after_turn"] == 6
    # a cycle has no order
    assert by[2, 0, 0]["after_turn"] is None and by[2, 0, 1]["depth"] is None
    assert by[2, 0, 0]["errors"] == ["arguments are no object"] and by[2, 0, 1]["errors"] == ["unknown tool"]
    assert by[2, 0, 2]["linked"] is False and by[2, 0, 2]["after_turn"] == 0
    assert by[2, 1, 0]["kind"] == "message" and by[2, 1, 0]["json"] == '{"content":"{broken","role":"assistant"}' and by[2, 2, 0]["json"] == '{"content":"","role":"tool"}'
    assert by[4, 0, 0]["errors"] == ["missing a", "b is not number"] and by[4, 0, 0]["after_turn"] == 0
    for r in rows:
        found = json.loads(r["json"])
        assert json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]


def test_every_item_stands_behind_what_it_follows(spark):
    chain = [(7, i, "assistant", call({"id": f"c{i}", "name": "ping", "arguments": {}, "after": [f"c{i + 1}"] if i < 9 else []})) for i in range(10)]
    chain += [(7, 10 + i, "tool", result(f"c{i}")) for i in range(10)]
    rows = link_tool_calls(tool_items(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string"), SCHEMAS)).collect()
    order = {(r["kind"], r["id"]): (r["after_turn"], r["depth"], r["turn"], r["pos"]) for r in rows}
    for i in range(9):
        assert order["call", f"c{i + 1}"] < order["result", f"c{i + 1}"] < order["call", f"c{i}"] < order["result", f"c{i}"]


def test_empty_and_repeated(spark):
    t = table(spark)
    assert link_tool_calls(tool_items(t.limit(0), SCHEMAS)).count() == 0
    rows = [r for r in ROWS if r[0] == 1] * 2
    assert link_tool_calls(tool_items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS)).count() == 16
