"""Line dedup against a plain search for earlier copies."""

import random

import pytest

from runledger.llm import line_dedup


def plain(docs, min_words):
    """docs in order: list of line lists -> kept lines. Quadratic."""
    places = [(d, i) for d, lines in enumerate(docs) for i in range(len(lines))]
    gone = set()
    for n, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:n]:
            k = 0
            while i + k < len(docs[d]) and j + k < len(docs[e]) and docs[d][i + k] == docs[e][j + k]:
                k += 1
            best = max(best, k)
        if sum(len(x.split()) for x in docs[d][i : i + best]) >= min_words:
            gone |= {(d, i + k) for k in range(best)}
    return ["\n".join(x for i, x in enumerate(lines) if (d, i) not in gone) for d, lines in enumerate(docs)]


def random_docs(seed, documents, alphabet):
    draw = random.Random(seed)
    lines = [" ".join(f"w{i}" for _ in range(draw.randint(0, 4))) + draw.choice(["", " "]) for i in range(alphabet)]
    docs = [[draw.choice(lines) for _ in range(draw.randint(1, 9))] for _ in range(documents)]
    passage = [draw.choice(lines) for _ in range(6)]
    return docs + [docs[0], passage + docs[1], docs[2] + passage, passage, ["same"] * 12, ["same"] * 5]


@pytest.mark.parametrize(("seed", "documents", "alphabet", "min_words"), [(1, 12, 3, 4), (2, 20, 8, 5), (3, 25, 30, 3), (4, 6, 2, 6)])
def test_matches_the_plain_search(spark, seed, documents, alphabet, min_words):
    docs = random_docs(seed, documents, alphabet)
    table = spark.createDataFrame([(i, "\n".join(x), i, "c") for i, x in enumerate(docs)], "doc_id long, text string, cuts_ int, id string").repartition(3)
    found = line_dedup.drop_repeated_runs(table, min_words=min_words, removed_col="removed")
    assert found.columns == ["doc_id", "text", "cuts_", "id", "removed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [rows[i]["text"] for i in range(len(docs))] == plain(docs, min_words)
    for i, lines in enumerate(docs):
        left = rows[i]["text"].split("\n") if rows[i]["removed"] < len(lines) else []
        assert rows[i]["removed"] == len(lines) - len(left) and rows[i]["cuts_"] == i


def test_nulls_repeated_rows_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long + "\nown"), (1, long + "\nown"), (None, long), (None, None), (2, None), (3, ""), (4, ""), (2, "other\n" + long + "\n\n")]
    found = line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, long + "\nown"), (1, long + "\nown"), (None, ""), (None, None), (2, None), (3, ""), (4, ""), (2, "other\n\n")], key=repr)


def test_empty_and_unrepeated(spark):
    assert line_dedup.drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a\nb"), (2, "c")]
    assert sorted(map(tuple, line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect())) == rows


def test_one_very_long_document(spark):
    lines = [f"line {i % 700} of a long text" for i in range(2100)]
    found = line_dedup.drop_repeated_runs(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), removed_col="n").first()
    assert found["text"] == "\n".join(lines[:700]) and found["n"] == 1400
