"""Depths by sweeps over blocks: long chains, several dependencies, turns, cycles, blocks of any size."""

import random

import pytest

from runledger.llm import tool_calls

SCHEMAS = {"now": {}}
CALL = "conversation long, position long, call string, name string, arguments string, after array<string>"
RESULT = "conversation long, position long, call string, content string"


def depths(spark, after, conversation=lambda i: 1):
    calls = [(conversation(i), i, c, "now", "{}", deps) for i, (c, deps) in enumerate(after.items())]
    rows = tool_calls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), SCHEMAS).collect()
    assert len(rows) == len(calls)
    return {r["call"]: r["depth"] for r in rows}


def plain(after):
    known, waiting = {}, dict(after)
    while ready := [c for c, deps in waiting.items() if all(d in known for d in deps if d in after)]:
        for c in ready:
            known[c] = max((known[d] + 1 for d in waiting.pop(c) if d in after), default=0)
    return {c: known.get(c) for c in after}


def counted(monkeypatch):
    written, stage = [], tool_calls.stage
    monkeypatch.setattr(tool_calls, "stage", lambda df, name="stage": written.append(name) or stage(df, name))
    return written


@pytest.mark.parametrize("step", [1, -1])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, step):
    """1000 calls with two dependencies each, all behind the call or all ahead of it."""
    written = counted(monkeypatch)
    names = [f"n{i}" for i in range(1000)][::step]
    after = {n: [] for n in sorted(names, key=lambda n: int(n[1:]))}
    for i, n in enumerate(names):
        after[n] = names[max(0, i - 2) : i]
    assert depths(spark, after) == {n: i for i, n in enumerate(names)}
    assert written.count("swept") <= 6


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_any_graph_and_block(spark, monkeypatch, block):
    monkeypatch.setattr(tool_calls, "BLOCK", block)
    draw = random.Random(block)
    names = [f"n{i}" for i in range(24)]
    after = {n: [draw.choice(names[:i]) for _ in range(draw.randrange(4))] if i else [] for i, n in enumerate(names)}
    after["n3"], after["n9"] = ["n11", "n0"], ["n9", "n2"]  # one ahead, one of itself
    after |= {"a": ["b"], "b": ["c", "n0"], "c": ["a"], "behind": ["c"], "lost": ["unknown"]}
    assert depths(spark, after) == plain(after)


def test_conversations_share_blocks(spark):
    after = {f"c{i}": [f"c{i - 3}"] if i >= 3 else [] for i in range(60)}
    assert depths(spark, after, lambda i: [7, None, 9][i % 3]) == plain(after)
