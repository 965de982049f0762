"""Every call and every result keeps its row: repeated identifiers, several conversations, null conversations, hot identifiers."""

import json
from collections import Counter

import pytest

from runledger.llm import tool_calls

SCHEMAS = {"add": {"a": ("number", True)}, "now": {}}
CALL = "conversation long, position long, call string, name string, arguments string, after array<string>"
RESULT = "conversation long, position long, call string, content string"


def linked(spark, calls, results):
    return tool_calls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS).collect()


@pytest.mark.parametrize("hot", [tool_calls.HOT_ROWS, 1])
def test_repeated_identifiers_keep_every_row(spark, monkeypatch, hot):
    monkeypatch.setattr(tool_calls, "HOT_ROWS", hot)
    calls = [(1, 0, "a", "now", "{}", []), (1, 1, "x", "add", '{"a":1}', []), (1, 4, "x", "add", '{"a":"one"}', ["a"]), (1, 4, "x", "add", '{"a":"one"}', ["a"]), (1, 6, "y", "now", "{}", []), (1, 7, "y", "now", "{", [])]
    results = [(1, 2, "x", "first"), (1, 5, "x", "second"), (1, 5, "x", "second"), (1, 8, "gone", "one"), (1, 9, "gone", "two")]
    rows = linked(spark, calls, results)
    found = Counter((r["position"], r["call"], r["status"], r["depth"], tuple(r["errors"]), r["repeats"], r["results"], json.loads(r["json"]).get("result")) for r in rows)
    assert found == Counter({
        (0, "a", "unanswered", 0, (), 0, 0, None): 1, (1, "x", "answered", 0, (), 2, 3, "first"): 1, (4, "x", "answered", 1, ("a is no number",), 2, 3, None): 2, (5, "x", "answered", None, (), 2, 3, "second"): 2,
        (6, "y", "unanswered", 0, (), 1, 0, None): 1, (7, "y", "unanswered", 0, ("not JSON",), 1, 0, None): 1, (8, "gone", "orphan", None, (), None, 2, "one"): 1, (9, "gone", "orphan", None, (), None, 2, "two"): 1,
    })


def test_conversations_are_apart(spark):
    calls = [(c, 0, "call_0", "add", json.dumps({"a": c or 0}), []) for c in (1, 2, 3, None)] + [(c, 2, "call_1", "now", "{}", ["call_0"]) for c in (1, 4)]
    results = [(c, 1, "call_0", f"of {c}") for c in (1, 2, None, 5)]
    found = {(r["conversation"], r["call"]): (r["status"], r["depth"], r["repeats"], r["results"], json.loads(r["json"]).get("result")) for r in linked(spark, calls, results)}
    assert found == {
        (1, "call_0"): ("answered", 0, 0, 1, "of 1"), (2, "call_0"): ("answered", 0, 0, 1, "of 2"), (3, "call_0"): ("unanswered", 0, 0, 0, None), (None, "call_0"): ("answered", 0, 0, 1, "of None"),
        (5, "call_0"): ("orphan", None, None, 1, "of 5"), (1, "call_1"): ("unanswered", 1, 0, 0, None), (4, "call_1"): ("unanswered", 0, 0, 0, None),
    }


def test_a_frequent_identifier_loses_nothing(spark):
    calls = [(i % 3, i, "hot" if i % 3 == 0 else f"c{i}", "add", json.dumps({"a": i}), []) for i in range(600)]
    results = [(0, 1000 + i, "hot", str(i)) for i in range(300)]
    rows = linked(spark, calls, results)
    texts = [json.loads(r["json"]) for r in rows]
    assert sorted(t["arguments"]["a"] for t in texts if "arguments" in t) == list(range(600))
    assert sorted(int(t["result"]) for t in texts if "result" in t) == list(range(300)) and len(rows) == 600 + 299
