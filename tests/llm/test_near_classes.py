"""Near classes as the registered query returns them: near copies, dense groups, large buckets and known edits."""

import os
import random

import numpy as np
import pytest

from runledger.llm import edit_fingerprints, queries

DATA = "/root/testdata/sf0.001"
WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(2 + i % 8)) for i in range(400)]


def edited(draw, text, times):
    parts = text.split()
    for _ in range(times):
        parts[draw.randrange(len(parts))] = draw.choice(WORDS)
    return " ".join(parts)


def all_pairs(rows):
    """id -> smallest id of its class, by comparing every pair."""
    ids = sorted(rows)
    table = np.array([np.unpackbits(np.frombuffer(bytes.fromhex(rows[d]), np.uint8)) for d in ids])
    root = np.arange(len(ids))
    for i in range(len(ids)):
        near = np.flatnonzero(1 - 2 * (table != table[i]).sum(axis=1) / edit_fingerprints.BITS >= edit_fingerprints.LIKENESS)
        joined = np.unique(root[near])
        root[np.isin(root, joined)] = joined[0]
    return {d: ids[r] for d, r in zip(ids, root, strict=True)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_returns_the_classes_of_the_whole_table(spark):
    rows = queries.op5_edit_fingerprints(spark, DATA).collect()
    wanted = all_pairs({r["doc_id"]: r["fingerprint"] for r in rows})
    wrong = [r["doc_id"] for r in rows if r["class_id"] != wanted[r["doc_id"]]]
    assert len(rows) == len(wanted) and len(wrong) <= 0.01 * len(rows)
    assert any(r["class_id"] != r["doc_id"] for r in rows)


@pytest.mark.parametrize("limit", [edit_fingerprints.BUCKET_ROWS, 20])
def test_a_dense_group_is_one_class(spark, limit):
    """A group of near copies, above NEAR_ROWS in its buckets, and above a bucket's limit."""
    draw = random.Random(8)
    base = " ".join(draw.choice(WORDS) for _ in range(200))
    docs = [(i, edited(draw, base, 1)) for i in range(150)] + [(1000 + i, " ".join(draw.choice(WORDS) for _ in range(200))) for i in range(50)]
    table = edit_fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string"))
    wanted = all_pairs({r["doc_id"]: r["fingerprint"] for r in table.collect()})
    rows = table.select(edit_fingerprints.F.col("doc_id").alias("id"), edit_fingerprints.F.unhex("fingerprint").alias("raw"))
    found = {r["id"]: r["class_id"] for r in rows.join(edit_fingerprints.shared_classes(rows, limit=limit), "raw", "left").collect()}
    wrong = [d for d in wanted if (found[d] if found[d] is not None else d) != wanted[d]]
    assert len(wrong) <= 2 and sum(found[d] == 0 for d in range(150)) > 100


def test_likeness_on_known_edits():
    """One changed word of 300: most texts stay above LIKENESS; unrelated texts are far below."""
    draw, embedding = random.Random(11), edit_fingerprints.Embedding()
    texts = [" ".join(draw.choice(WORDS) for _ in range(300)) for _ in range(200)]
    table = [edit_fingerprints.Text(0, t) for t in [*texts, *(edited(draw, t, 1) for t in texts)]]
    edit_fingerprints._walked(embedding, table)
    bits = np.array([t.bits for t in table])
    near = 1 - 2 * (bits[:200] != bits[200:]).mean(axis=1)
    assert (near >= edit_fingerprints.LIKENESS).mean() >= 0.85
    apart = 1 - 2 * (bits[:200, None] != bits[None, :200]).mean(axis=2)
    assert apart[np.triu_indices(200, 1)].max() < edit_fingerprints.LIKENESS - 0.2
