"""Removed bytes against every string of every text."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from runledger.llm import prefix_free_parse, queries

DATA = "/root/testdata/sf0.001"


def plain(texts, length):
    """For each text (removed spans, kept bytes)."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for data in raw:
        gone = np.zeros(len(data) + 2, np.int8)
        for i in range(len(data) - length + 1):
            if counts[data[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = 1
        edges = np.flatnonzero(np.diff(gone)).tolist()
        out.append((list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(data, gone[1:], strict=False) if not g)))
    return out


def check(spark, texts, length, **options):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, a int, covers string").repartition(3)
    rows = {r["doc_id"]: r for r in prefix_free_parse.drop_repeats(table, length=length, **options).collect()}
    assert len(rows) == len(texts)
    for i, (spans, kept) in enumerate(plain(texts, length)):
        assert [tuple(s) for s in rows[i]["removed"]] == spans, i
        assert bytes(rows[i]["kept"]) == kept and rows[i]["n_bytes"] == len((texts[i] or "").encode())
    return rows


def random_texts(seed, n):
    """Texts of shared passages, edited copies, repeats inside a text, and junctions of passages."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 5)))
    fresh = lambda m: " ".join(word() for _ in range(m))
    passages = [fresh(draw.randint(3, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.6 else fresh(draw.randint(1, 25)) for _ in range(draw.randint(1, 6))]
        texts.append(" ".join(parts))
    for _ in range(n // 2):
        copy = list(draw.choice(texts))
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice("xyz")
        texts.append("".join(copy[draw.randint(0, 5) :]))
    return texts


@pytest.mark.parametrize(("seed", "length", "window", "modulus"), [(1, 40, 4, 6), (2, 60, 8, 9), (3, 30, 4, 30), (4, 50, 2, 3), (5, 24, 16, 5)])
def test_matches_every_string(spark, seed, length, window, modulus):
    rows = check(spark, random_texts(seed, 30), length, window=window, modulus=modulus)
    assert 5 < sum(bool(r["removed"]) for r in rows.values())


def test_periodic_and_odd_texts(spark):
    texts = [None, "", "a", "a" * 39, "a" * 40, "b" * 41, "ab" * 300, "ab" * 30 + "c" + "ab" * 25, "é" * 60, "日本" * 50, "x" * 20 + "y" * 30 + "x" * 20, "\n" * 90 + "tail", ""]
    check(spark, texts, 40, window=4, modulus=5)


def test_copies_at_the_full_length(spark):
    draw = random.Random(8)
    base = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(600))
    texts = [base, base, base[:399], base[500:900], base[100:499] + "#" + base[600:1001], base[700:1099], "short", "head " + base[1200:1650] + " tail"]
    rows = check(spark, texts, 400)
    assert rows[0]["removed"][0]["end"] == len(base) and not rows[2]["removed"] and not rows[5]["removed"]


def test_very_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_free_parse, "CHUNK", 1000)
    draw = random.Random(4)
    long = " ".join(str(draw.randrange(10**6)) for _ in range(9000))
    check(spark, [long + long[2000:2500], long[7000:7600] + "x"], 400)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_free_parse.drop_repeats(empty).collect() == []


def test_triggers_don_t_depend_on_the_chunk(monkeypatch):
    draw = random.Random(6)
    data = bytes(draw.randrange(256) for _ in range(5000))
    whole = prefix_free_parse.triggers(data, 16, 7).tolist()
    monkeypatch.setattr(prefix_free_parse, "CHUNK", 333)
    assert prefix_free_parse.triggers(data, 16, 7).tolist() == whole and len(whole) > 500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    import hashlib

    docs = queries.read(spark, DATA, "documents").collect()
    rows = {r["doc_id"]: r for r in queries.op12_prefix_free_parse(spark, DATA).collect()}
    assert len(rows) == len(docs)
    for doc, (spans, kept) in zip(docs, plain([d["text"] for d in docs], 400), strict=True):
        row = rows[doc["doc_id"]]
        assert (row["n_bytes"], row["n_spans"]) == (len((doc["text"] or "").encode()), len(spans))
        assert row["n_removed"] == sum(e - s for s, e in spans) and row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
