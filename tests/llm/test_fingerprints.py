"""The edit embedding: its defined results exactly, its likeness on texts with known edits."""

import hashlib
import os
import random

import pytest

from runledger.llm import edit_fingerprints, queries

DATA = "/root/testdata/sf0.001"


def expected_edits(docs):
    """(id, text) in order -> id, n_chars, hash of the edited text."""
    found = []
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1] or ""
        text = text or ""
        cut = len(text) // 3
        found.append((key, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read(spark, DATA, "documents").orderBy("doc_id", ascending=False).collect()]
    rows = {r["doc_id"]: r for r in queries.op5_edit_fingerprints(spark, DATA).collect()}
    assert [(d, rows[d]["n_chars"], rows[d]["edited_sha256"]) for d, _ in docs] == expected_edits(docs)
    by_text = {}
    for i, (d, text) in enumerate(docs):
        r, following = rows[d], rows[docs[(i + 1) % len(docs)][0]]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == edit_fingerprints.BITS // 4
        differ = bin(int(r["fingerprint"], 16) ^ int(following["fingerprint"], 16)).count("1")
        assert r["near_next"] == pytest.approx(max(0, 1 - 2 * differ / edit_fingerprints.BITS))
        differ = bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1")
        assert r["near_edited"] == pytest.approx(max(0, 1 - 2 * differ / edit_fingerprints.BITS))
    assert sum(r["near_edited"] > 0.5 for r in rows.values()) > 0.97 * len(rows)
    assert sum(r["near_next"] < 0.4 for r in rows.values()) > 0.97 * len(rows)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_order_nulls_ties_and_seams(spark, monkeypatch, partitions):
    docs = [(9, "nine " * 30), (8, None), (7, ""), (6, "🙂é" * 50), (5, "five"), (3, "x"), (2, "nine " * 30), (None, "null id")]
    table = spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id long, text string, role string, part int").repartition(3)
    found = {r["doc_id"]: (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in edit_fingerprints.fingerprint_edits(table, partitions=partitions).collect()}
    assert [found[d][:3] for d, _ in docs] == expected_edits(docs)
    assert found[9][3] == found[2][3] and found[7][3] == found[8][3] == "0" * (edit_fingerprints.BITS // 4)


def test_few_documents(spark):
    schema = "doc_id long, text string"
    assert edit_fingerprints.fingerprint_edits(spark.createDataFrame([], schema)).collect() == []
    only = edit_fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in only] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    twice = edit_fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdef"), (1, "abcdef")], schema)).collect()
    assert [r["edited_sha256"] for r in twice] == [hashlib.sha256(b"abcdab").hexdigest()] * 2


def test_chunks_give_the_same_walks():
    embedding = edit_fingerprints.Embedding()
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 400))) for _ in range(40)]
    alone = []
    for t in texts:
        one = edit_fingerprints.Text(0, t)
        edit_fingerprints._walked(embedding, [one])
        alone.append(one.bits.tolist())
    together = [edit_fingerprints.Text(0, t) for t in texts]
    edit_fingerprints._walked(embedding, together)
    assert [t.bits.tolist() for t in together] == alone


def test_walks_follow_the_definition():
    """Step by step: put out the character, then move on or stay as the shared bit says."""
    embedding = edit_fingerprints.Embedding()
    text = edit_fingerprints.Text(0, "a randomised edit embedding, walked by hand" * 5)
    edit_fingerprints._walked(embedding, [text])
    step, entered = 0, []
    for point in text.points.tolist():
        entered.append(step)
        klass = ((point * 2654435761) % (1 << 32)) >> 26
        moved = False
        while not moved:
            moved = embedding.wait[klass * edit_fingerprints.PERIOD + step % edit_fingerprints.PERIOD] == 1
            step += 1
    assert text.entered.tolist() == entered and text.last == step


def test_near_copies_are_found_and_verified(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    text = lambda: " ".join(draw.choice(words) for _ in range(300))
    originals = [text() for _ in range(30)]
    docs = []
    for i, t in enumerate(originals):
        parts = t.split()
        del parts[draw.randrange(300)]
        parts.insert(draw.randrange(299), "added")
        docs += [(2 * i, t), (2 * i + 1, " ".join(parts))]
    docs += [(1000 + i, originals[0]) for i in range(50)]
    table = edit_fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string"))
    of = {r["doc_id"]: r["fingerprint"] for r in table.collect()}
    alike = lambda a, b: 1 - 2 * bin(int(a, 16) ^ int(b, 16)).count("1") / edit_fingerprints.BITS
    ids = sorted(of)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if root[a] != root[b] and alike(of[a], of[b]) >= edit_fingerprints.LIKENESS:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    found = {r["doc_id"]: (r["class_id"], r["documents"]) for r in edit_fingerprints.near_classes(table).collect()}
    assert sum(root[2 * i] == root[2 * i + 1] for i in range(30)) >= 15 and root[1049] == 0
    wrong = [d for d in ids if found[d][0] != root[d]]
    assert len(wrong) <= 1 and all(found[d][0] == d for d in wrong)
    assert all(n == sum(c == found[d][0] for c, _ in found.values()) for d, (_, n) in found.items())


def test_classes_of_few_rows(spark):
    schema = "doc_id long, fingerprint string, node long"
    zero, far = "00" * (edit_fingerprints.BITS // 8), "0f" * (edit_fingerprints.BITS // 8)
    table = spark.createDataFrame([(3, zero, 1), (2, zero, 1), (None, far, 1), (5, None, 1), (6, None, 1)], schema)
    found = sorted(map(tuple, edit_fingerprints.near_classes(table).collect()), key=repr)
    assert found == sorted([(2, 2, 2), (3, 2, 2), (None, None, 1)], key=repr) or found == sorted([(2, 2, 2), (3, 2, 2), (None, None, 1), (5, 5, 2), (6, 5, 2)], key=repr)
    assert edit_fingerprints.near_classes(table.limit(0)).collect() == []
