"""Shape features over the whole text, and a fit that is bounded by its labels."""

from collections import Counter

import pytest

from runledger.llm import quality


@pytest.mark.parametrize("text", ["buy a buy b buy c buy d buy e buy f buy g buy h", "a a b c d e f g h a", "one two three", "x", "", "b b a a b"])
def test_top_word_is_the_share_of_the_most_frequent_word(text):
    words = text.split()
    shape = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    assert shape["top_word"] == pytest.approx(max(Counter(words).values()) / len(words) if words else 1.0)


def test_a_repeated_id_is_fitted_once_for_each_of_its_labels(spark, monkeypatch):
    docs = [(1, f"copy number {i} of a text") for i in range(300)] + [(i, f"text {i} " * i) for i in range(2, 21)] + [(None, "no id")]
    labels = [(i, float(i % 2)) for i in range(1, 21)] + [(2, 0.0), (99, 1.0)]
    rows = []
    monkeypatch.setattr(quality, "Model", lambda x, y: rows.extend(zip(x.tolist(), y.tolist(), strict=True)))
    quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality double"))
    assert len(rows) == 21 and sum(y for _, y in rows) == 10
    of_two = [x for x, _ in rows if x == pytest.approx(quality.features("text 2 " * 2))]
    assert len(of_two) == 2
