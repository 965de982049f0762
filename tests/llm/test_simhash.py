"""SimHash near-duplicates against all-pairs comparison."""

import os

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from runledger.llm import queries, simhash_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=3):
    """Root (smallest position) of each value, all pairs compared."""
    values = np.array(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


TEXTS = [None, "", "  ", "One two", "one TWO", "a b c d e f g", "a b c d e f h", "É é x\x1cy z", "w " * 30_000, " ".join(map(str, range(40_000)))]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, f string")
    got = {r["doc_id"]: r["f"] % (1 << 64) for r in simhash_dedup.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def clustered(seed, centres, size, flips):
    draw = np.random.default_rng(seed)
    values = []
    for c in draw.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(int(draw.integers(1, size))):
            v = int(c)
            for bit in draw.integers(0, 64, draw.integers(0, flips)):
                v ^= 1 << int(bit)
            values.append(v)
    return np.unique(np.array([*values, 0, 2**64 - 1], np.uint64))


@pytest.mark.parametrize(("seed", "centres", "size", "flips"), [(0, 200, 20, 4), (1, 3, 600, 5), (2, 1500, 2, 1), (3, 1, 900, 9)])
def test_tree_links_what_all_pairs_link(seed, centres, size, flips):
    values = clustered(seed, centres, size, flips)
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    values = values[np.argsort(rank)]
    root = simhash_dedup.links(np.zeros(len(values), np.int64), values, pairs=1 << 12)
    assert same_partition(root.tolist(), plain_components(values).tolist())


def test_tree_keeps_buckets_apart():
    values = np.array([5, 5, 4, 4], np.uint64)
    assert simhash_dedup.links(np.array([1, 2, 2, 3]), values).tolist() == [0, 1, 1, 3]


@pytest.mark.parametrize("limit", [4096, 8])
def test_components_over_tasks_and_dealt_buckets(spark, limit):
    values = clustered(7, 60, 30, 4).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in values], "f long").repartition(5)
    stars = simhash_dedup.star_links(simhash_dedup.buckets(nodes, limit=limit), index_rows=50)
    found = {r["f"]: r["root"] for r in simhash_dedup.components(stars).collect()}
    roots = [found.get(v, v) for v in values]
    assert same_partition(roots, plain_components(np.array(values, np.int64).view(np.uint64)).tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_matches_all_pairs(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in queries.read(spark, DATA, "documents").collect())
    values = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(values)
    expected = {d: (f"{v:016x}", docs[r][0]) for (d, _), v, r in zip(docs, values, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, DATA).collect()} == expected


def test_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (2, "A b c d"), (None, "a b  c d"), (5, None), (6, ""), (None, "x y z"), (2, "A b c d"), (2, "other words here")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["documents"]) for r in simhash_dedup.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(3, 2, 4), (2, 2, 4), (None, 2, 4), (2, 2, 4), (5, 5, 2), (6, 5, 2), (None, None, 1), (2, 2, 1)], key=repr)
    kept = sorted(map(tuple, simhash_dedup.one_of_each(docs.withColumn("component_id", docs.doc_id)).collect()), key=repr)
    assert kept == sorted([(2, "A b c d", 2), (5, None, 5), (None, "x y z", None), (2, "other words here", 2)], key=repr)
    assert simhash_dedup.near_duplicates(docs.limit(0)).collect() == [] and simhash_dedup.one_of_each(docs.limit(0)).collect() == []
