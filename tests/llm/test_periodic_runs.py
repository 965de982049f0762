"""Periodic runs against the definition."""

import hashlib
import os
import random
import zlib

import pytest

from runledger.llm import periodic_runs, queries

DATA = "/root/testdata/sf0.001"


def plain(words, least=6, times=4):
    """Every run by trying all periods, least first."""
    found = {}
    for period in range(1, len(words) // times + 1):
        i = 0
        while i + period < len(words):
            if words[i] != words[i + period]:
                i += 1
                continue
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(least, times * period):
                found.setdefault((i, j - i + period), period)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(draw):
    words = [draw.choice("abcd"[: draw.choice([1, 2, 2, 3, 4])]) for _ in range(draw.randint(0, 70))]
    if draw.random() < 0.6 and words:
        first = draw.randrange(len(words))
        period = 1 + draw.randrange((len(words) - first) // 3 + 1)
        words = [w if i < first else words[min(first + (i - first) % period, len(words) - 1)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_the_definition(seed):
    draw = random.Random(seed)
    documents = [random_words(draw) for _ in range(800)]
    found = periodic_runs.runs_of([[w.encode() for w in words] for words in documents])
    assert found == [plain(words) for words in documents] and sum(map(len, found)) > 100


def test_other_limits():
    draw = random.Random(9)
    documents = [random_words(draw) for _ in range(400)]
    coded = [[w.encode() for w in words] for words in documents]
    assert periodic_runs.runs_of(coded, least=12, times=5) == [plain(words, 12, 5) for words in documents]
    assert periodic_runs.runs_of(coded, least=9, times=6) == [plain(words, 9, 6) for words in documents]
    for limits in ({"times": 3}, {"least": 4}):
        with pytest.raises(ValueError):
            periodic_runs.periodic_runs(None, **limits)


def test_places_keep_their_order():
    draw = random.Random(5)
    numbers = draw.sample(range(100_000), 5000)
    places, seen = periodic_runs.Places(numbers[0]), {numbers[0]}
    for n in numbers[1:]:
        places.add(n)
        seen.add(n)
    assert [p for block in places.blocks for p in block] == sorted(seen) and len(places.blocks) > 1
    for probe in draw.sample(range(-5, 100_010), 300):
        later, earlier = [n for n in seen if n >= probe], [n for n in seen if n <= probe]
        assert places.first_from(probe) == (min(later) if later else probe + (1 << 62))
        assert places.last_to(probe) == (max(earlier) if earlier else -1)


def test_table_with_nulls_repeats_and_long_texts(spark):
    long = "x " + "a b c " * 30_000 + "y"
    rows = [(1, long, 1, "r"), (2, None, 1, "r"), (None, "a a a a a a", 2, "r"), (3, "", 0, None), (3, " \t\x0b\n", 0, None), (4, "b b " * 5 + "b", 0, "z"), (4, "b b " * 5 + "b", 0, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3)
    found = sorted((tuple(r) for r in periodic_runs.periodic_runs(table, batch_words=10).collect()), key=repr)
    # A no-break space is no white space here, so five such words are too few.
    short = "b b b b b b b b b b b"
    expected = [(1, 90_002, [(1, 90_000, 3)], "x a b c y"), (2, 0, [], ""), (None, 6, [(0, 6, 1)], "a"), (3, 0, [], ""), (3, 0, [], ""), (4, 6, [], short), (4, 6, [], short)]
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in found] == sorted(expected, key=repr)
    assert periodic_runs.periodic_runs(table.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    docs = queries.read(spark, DATA, "documents").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        words = (doc["text"] or "").encode().split()
        h = zlib.crc32(str(doc["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = plain(words), rows[doc["doc_id"]]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()
