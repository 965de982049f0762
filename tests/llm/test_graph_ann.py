"""Approximate neighbours against brute force."""

import os

import numpy as np
import pytest

from runledger.llm import graph_ann, queries

DATA = "/root/testdata/sf0.01"


def brute(ids, vectors, queries, k=10):
    found = {}
    for i, v in zip(ids, vectors, strict=True):
        if i in queries:
            distances = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            found[i] = sorted((d, j) for d, j in zip(distances.tolist(), ids, strict=True) if j != i)[:k]
    return found


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_reaches_the_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.read(spark, DATA, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, vectors = [i for i, _ in rows], np.array([v for _, v in rows], float)
    expected = brute(ids, vectors, {i for i in ids if i % 100 == 0})
    found = by_query(queries.op7_nearest_vectors(spark, DATA).collect())
    assert set(found) == set(expected) and all(len(x) == 10 for x in found.values())
    hits = sum(len({i for _, i in found[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    for q, pairs in found.items():
        exact = {i: float(np.sqrt(((vectors[ids.index(i)] - vectors[ids.index(q)]) ** 2).sum())) for _, i in pairs}
        assert pairs == sorted(pairs) and all(s == pytest.approx(exact[i], rel=1e-12) for s, i in pairs)


def test_many_shards_and_a_very_frequent_vector(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(900, 8))
    vectors[300:700] = vectors[300]
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, shard int").repartition(4)
    index = graph_ann.build_index(table, shard_rows=100)
    assert index.count() == 9
    found = by_query(graph_ann.search(index, table.filter("vec_id % 50 = 0")).collect())
    expected = brute(list(range(900)), vectors, set(range(0, 900, 50)))
    hits = sum(len({i for _, i in found[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    assert [i for _, i in found[300]] == list(range(301, 311)) and [i for _, i in found[400]] == list(range(300, 310))


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.5]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (100, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = by_query(graph_ann.search(graph_ann.build_index(table), table).collect())
    assert found == {0: [(1.0, 1), (1.0, 8)], 1: [(1.0, 0), (2**0.5, 8)], 8: [(1.0, 0), (2**0.5, 1)], 100: [(2**0.5, 200)], 200: [(2**0.5, 100)]}
    empty = table.limit(0)
    assert graph_ann.search(graph_ann.build_index(empty), empty).collect() == []
    assert graph_ann.search(graph_ann.build_index(table), empty).collect() == []
