"""Tool-call linking, ordering, validation and canonical JSON."""

import json
import os

import pytest

from runledger.llm import queries, tool_calls

DATA = "/root/testdata/sf0.001"
SCHEMAS = {"add": {"a": ("number", True), "b": ("integer", True), "note": ("string", False)}, "list": {"items": ("array", True), "deep": ("object", False), "on": ("boolean", False)}, "now": {}}
CALL = "conversation long, position long, call string, name string, arguments string, after array<string>, status string"
RESULT = "conversation long, position long, call string, content string, depth int"


def linked(spark, calls, results=()):
    rows = tool_calls.link_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALL), spark.createDataFrame([(*r, 1) for r in results], RESULT), SCHEMAS).collect()
    return {(r["call"], r["status"]): r for r in rows}


def test_links_and_statuses(spark):
    calls = [(1, 0, "x", "add", '{"b": 2, "a": 1.5}', []), (1, 2, "y", "now", "{}", ["x"]), (1, 3, None, "now", "{}", None), (1, 4, "x", "now", "{}", None)]
    results = [(1, 1, "x", "3.5"), (1, 5, "x", "later"), (1, 6, "gone", "?"), (1, 7, None, "lost")]
    found = linked(spark, calls, results)
    assert set(found) == {("x", "answered"), ("y", "unanswered"), (None, "unidentified"), ("gone", "orphan"), (None, "orphan")}
    x = found["x", "answered"]
    assert (x["depth"], x["repeats"], x["results"], x["errors"], x["json"]) == (0, 1, 2, [], '{"arguments":{"a":1.5,"b":2},"id":"x","name":"add","result":"3.5"}')
    assert found["y", "unanswered"]["depth"] == 1
    assert found["gone", "orphan"]["json"] == '{"id":"gone","result":"?"}'


@pytest.mark.parametrize(("name", "arguments", "errors"), [
    ("add", '{"a": 1, "b": 2}', []), ("add", '{"a": 1.25, "b": 2, "note": "x"}', []), ("add", '{"a": "1", "b": 2.5}', ["a is no number", "b is no integer"]),
    ("add", '{"a": 1}', ["missing b"]), ("add", '{"a": 1, "b": 2, "z": 0, "c": 0}', ["unexpected c", "unexpected z"]), ("add", '{"a": null, "b": 2}', ["a is no number"]),
    ("add", "{", ["not JSON"]), ("add", None, ["not JSON"]), ("add", "[1]", ["not an object"]), ("other", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]), ("now", "{}", []), ("now", '{"a":1}', ["unexpected a"]),
    ("list", '{"items": [], "deep": {"x": [1]}, "on": true}', []), ("list", '{"items": {}, "deep": [], "on": 1}', ["deep is no object", "items is no array", "on is no boolean"]),
])
def test_validation(spark, name, arguments, errors):
    assert linked(spark, [(1, 0, "x", name, arguments, None)])["x", "unanswered"]["errors"] == errors


def test_canonical_json(spark):
    texts = ['{"b":[1, 2.50,{"z":null,"a":"é\\n\\u0001\\"/"}],"a":{"y":1e2,"x":true}}', "nope", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tool_calls.canonical(tool_calls.F.col("t")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[1:] == [None, None] and json.loads(got[0]) == json.loads(texts[0]) and got[0].startswith('{"a":{"x":true,"y":') and " " not in got[0]


def plain_depths(after):
    known = {}
    while True:
        more = {c: max((known[d] + 1 for d in deps if d in after), default=0) for c, deps in after.items() if c not in known and all(d in known for d in deps if d in after)}
        if not more:
            return {c: known.get(c) for c in after}
        known |= more


def test_depths_of_chains_joins_and_cycles(spark):
    after = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(37)}  # a long chain
    after |= {"j1": ["n36", "n3", "n3"], "j2": ["j1", "n0"], "k": ["j2"], "l": ["k"], "m": ["l", "j1", "unknown"], "solo": ["unknown"]}
    after |= {"c1": ["c2"], "c2": ["c1"], "c3": ["c2"], "c4": ["c3", "n1"], "self": ["self"], "d1": ["d2", "n0"], "d2": ["d1", "n0"]}
    found = linked(spark, [(1, i, c, "now", "{}", deps) for i, (c, deps) in enumerate(after.items())])
    assert {c: r["depth"] for (c, _), r in found.items()} == plain_depths(after)


def test_empty_tables(spark):
    assert linked(spark, []) == {}
    assert set(linked(spark, [], [(1, 1, "x", "r")])) == {("x", "orphan")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_follows_the_turns(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in queries.read(spark, DATA, "conversations").collect()}
    rows = queries.op6_tool_calls(spark, DATA).collect()
    calls = {k: r for k, r in turns.items() if r["role"] not in ("assistant", "tool")}
    got = {r["call"]: r for r in rows}
    assert len(got) == len(rows)
    after = {f"c{c}-{t}": [f"c{c}-{t - 1}", f"c{c}-{t - 2}"] for c, t in calls}
    depths = plain_depths(after)
    for (c, t), turn in calls.items():
        r = got[f"c{c}-{t}"]
        answer = turns.get((c, t + 1))
        answer = answer if answer and answer["role"] in ("assistant", "tool") else None
        value = {"arguments": {"text": turn["text"], "turn": t}, "id": f"c{c}-{t}", "name": turn["role"]} | ({"result": answer["text"]} if answer else {})
        if turn["role"] == "user":
            value["arguments"]["words"] = len(turn["text"].split(" "))
        assert (r["conversation"], r["position"], r["depth"], r["status"], r["errors"]) == (c, t, depths[f"c{c}-{t}"], "answered" if answer else "unanswered", "")
        assert json.loads(r["json"]) == value and r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    orphans = {f"c{c}-{t - 1}" for (c, t), r in turns.items() if r["role"] in ("assistant", "tool") and (c, t - 1) not in calls}
    assert {r["call"] for r in rows if r["status"] == "orphan"} == orphans
