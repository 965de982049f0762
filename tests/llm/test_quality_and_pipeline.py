"""The quality classifier on held-out labels and against a plain shrinkage; the pipeline's stages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import quality, queries, simhash_dedup

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = queries.read(spark, DATA, "documents"), queries.read(spark, DATA, "labels")
    judged = quality.classify(docs, labels.filter("doc_id % 2 = 0"), keep=["doc_id"])
    held = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").select(F.col("verdict.keep").cast("int").alias("keep"), "quality").collect()
    good, bad = [r["keep"] for r in held if r["quality"] == 1], [r["keep"] for r in held if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def plain_posteriors(rows):
    """(host, path, probability) rows -> posteriors, by the same moments, in plain numpy."""
    def strength(n, total, mean):
        spread = (n * (total / n - mean) ** 2).sum() - (mean * (1 - mean)).sum() + (mean * (1 - mean)).mean()
        weight = n.sum() - (n * n).sum() / n.sum()
        between = max(spread / weight, 0) if weight > 0 else 0
        m = mean.mean()
        return min(max(m * (1 - m) / between - 1 if between > 1e-9 else quality.MOST_STRENGTH, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    def totals(key):
        keys = sorted({key(r) for r in rows}, key=repr)
        return keys, np.array([float(sum(key(r) == k for r in rows)) for k in keys]), np.array([sum(r[2] for r in rows if key(r) == k) for k in keys])

    prior = np.mean([r[2] for r in rows])
    hosts, n, total = totals(lambda r: r[0])
    s = strength(n, total, np.full(len(n), prior))
    host = dict(zip(hosts, (prior * s + total) / (s + n), strict=True))
    paths, n, total = totals(lambda r: r[:2])
    parent = np.array([host[h] for h, _ in paths])
    s = strength(n, total, parent)
    return {p: (host[p[0]], x) for p, x in zip(paths, (s * parent + total) / (s + n), strict=True)}


def test_posteriors_match_a_plain_shrinkage(spark):
    draw = np.random.default_rng(0)
    rows = [(h, p, float(np.round(q, 6))) for h, centre in (("a", 0.9), ("b", 0.3), ("c", 0.6), (None, 0.8)) for p, n in (("x", 40), ("y", 3), (None, 1)) for q in np.clip(draw.normal(centre, 0.1, n), 0, 1)]
    found = quality.posteriors(spark.createDataFrame(rows, "h string, p string, q double").repartition(3), "h", "p", "q").collect()
    expected = plain_posteriors(rows)
    assert {(r["host"], r["path"]) for r in found} == set(expected)
    for r in found:
        assert (r["host_posterior"], r["path_posterior"]) == pytest.approx(expected[r["host"], r["path"]], abs=1e-6)


def test_sparse_sites_shrink_and_full_ones_count(spark):
    rows = [("good", "x", 0.95)] * 500 + [("bad", "x", 0.05)] * 500 + [("rare", "x", 0.05)] * 1 + [("mid", "x", 0.5)] * 500
    found = {r["host"]: r for r in quality.posteriors(spark.createDataFrame(rows, "h string, p string, q double"), "h", "p", "q").collect()}
    assert found["good"]["path_posterior"] > 0.9 and found["bad"]["path_posterior"] < 0.1 < 0.15 < found["rare"]["path_posterior"]


def test_nulls_repeated_rows_and_missing_labels(spark):
    columns = "doc_id long, text string, source string, lang string, verdict string"
    docs = spark.createDataFrame([(1, "plain words of a text", "s", "en", "v"), (1, "plain words of a text", "s", "en", "v"), (None, None, None, None, None), (2, "", "s", None, "v"), (3, "SHOUT!! " * 500, None, "en", "v")], columns)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    judged = quality.classify(docs, labels)
    assert judged.columns == ["doc_id", "text", "source", "lang", "verdict", "verdict_"] and judged.count() == 5
    assert all(0 <= r["verdict_"]["probability"] <= 1 for r in judged.collect())
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and 3 not in [r["doc_id"] for r in kept.collect()]
    assert quality.kept_documents(docs, labels.filter("quality = 1")).count() == 5
    assert quality.classify(docs.limit(0), labels).collect() == []


@needs_data
def test_pipeline_stages_take_effect(spark):
    docs = queries.read(spark, DATA, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash_dedup", "packing"]
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(step(spark, before, DATA), name)
        assert after.columns == corpus_pipeline.COLUMNS == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        came = {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in queries.read(spark, DATA, "labels").collect()}
            good = [d for d in came if labels.get(d) == 1]
            assert ids < came and sum(d in ids for d in good) >= 0.98 * len(good) and sum(d in ids for d in labels if labels[d] == 0) <= 0.2 * sum(q == 0 for q in labels.values())
        elif name == "line_dedup":
            assert ids == came and after.filter("n_chars <> coalesce(length(text), 0)").isEmpty() and after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
        else:
            assert ids == {r["component_id"] for r in simhash_dedup.near_duplicates(before).collect()}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()
