"""Audits by words of 64 runs equal those that join every planned run."""

import datetime

import pytest

from runledger.operators import gaps

CAMPAIGN = "regions array<string>, vm_sizes array<string>, node_counts array<int>, dataset_sizes array<int>, workloads array<string>, repetitions int"
RESULT = "region string, vm_size string, nodes int, dataset_size_mb int, workload string, run_number int, timestamp timestamp, exit_status string"
STATUS = "region string, vm_size string, nodes int, status string, note string"


@pytest.fixture(scope="module")
def tables(spark):
    campaigns = [
        (["a", "b"], ["D2", "D4"], [2], [500], ["cpu", "io"], 130), (["a"], ["D2"], [2, 4], [500, 1000], ["cpu"], 64),  # one cell is planned twice
        (["c"], ["D2"], [2], [500], ["cpu"], 1), (["c"], ["D4"], [2], [500], ["cpu"], 0), ([], ["D2"], [2], [500], ["cpu"], 9), (["d"], ["D2"], [2], [500], [None], 3), (["d"], ["D2"], [2], [500], ["cpu"], None),
    ]
    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    results = []
    for run in [-1, 0, 1, 2, 63, 64, 65, 100, 128, 129, 130, 131, 500, None]:
        results.append(("a", "D2", 2, 500, "cpu", run, day(0), "SUCCESS" if run is None or run % 2 else "FAILED"))
    results += [("a", "D2", 2, 500, "cpu", r, day(1), s) for r, s in ((64, "SUCCESS"), (65, "FAILED"), (100, "RUNNING"))]
    results += [("b", "D4", 2, 500, "io", r, day(0), "SUCCESS") for r in range(1, 131)] + [("d", "D2", 2, 500, None, 1, day(0), "SUCCESS"), ("elsewhere", "D2", 2, 500, "cpu", 1, day(0), "SUCCESS")]
    status = [("a", "D2", 4, "SKIPPED", "quota"), ("a", "D4", 2, "FAILED", None), ("b", "D4", 2, "SUCCESS", None)]
    return spark.createDataFrame(campaigns, CAMPAIGN), spark.createDataFrame(results, RESULT), spark.createDataFrame(status, STATUS)


def rows(df):
    return sorted((tuple(r) for r in df.select(*gaps.RUN_KEY, *[c for c in df.columns if c not in gaps.RUN_KEY]).collect()), key=str)


@pytest.mark.parametrize("success_wins", [False, True])
def test_words_equal_the_join_of_every_run(tables, success_wins):
    campaigns, results, status = tables
    wanted = gaps.audited_runs(gaps.expected_runs(campaigns), results, status, success_wins)
    words = gaps.audited_words(campaigns, results, status, success_wins)
    every = rows(wanted)
    assert rows(gaps.word_runs(words)) == every and len(every) > 500
    assert rows(gaps.word_runs(words, passed=True)) == rows(wanted.filter("passed"))
    assert rows(gaps.word_runs(words, passed=False)) == rows(wanted.filter("NOT passed"))
    by_combo = lambda df: sorted(tuple(r) for r in df.select(*gaps.COMBO, "runs", "retry_list_path").collect())
    assert by_combo(gaps.retry_words(words)) == by_combo(gaps.retry_index(wanted))


def test_only_words_meet(tables):
    """130 runs of a cell are three rows, whatever was seen of them."""
    campaigns, results, status = tables
    words = gaps.audited_words(campaigns, results, status)
    found = [(r["word"], r["wanted"]) for r in words.filter("region = 'a' AND vm_size = 'D2' AND nodes = 2 AND dataset_size_mb = 500 AND workload = 'cpu'").orderBy("word").collect()]
    assert found == [(0, -1), (1, -1), (2, 3)]


def test_empty_tables(tables):
    campaigns, results, status = tables
    assert rows(gaps.word_runs(gaps.audited_words(campaigns.limit(0), results, status))) == []
    open_runs = gaps.word_runs(gaps.audited_words(campaigns, results.limit(0), status.limit(0)))
    assert {(r["passed"], r["reason"], r["retry"]) for r in open_runs.collect()} == {(False, "never ran / missing", True)}
