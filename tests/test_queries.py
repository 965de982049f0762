"""Registered queries against their checking SQL on the smallest data set."""

import math
import os

import pytest

import __spark_entry__ as contract

DATA = os.environ.get("RUNLEDGER_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "a3_malformed_lines", "a6_carbon_payloads", "a6_quarantined_payloads", "a7_drifted_payloads", "a7_quarantined_payloads", "a7_unknown_fields", "a10_latest_runs", "b8_retry_lists", "c18_vcpu_inference", "d4_sla_fallback", "e4_nearest_readings",
    "e13_priced_runs", "e14_pareto_front", "f3_profile_rollup", "f11_numeric_profile", "f25_paired_tests", "g6_tradeoff", "j3_holdout_split", "k4_cleaned_runs",
    "k5_merged_per_run", "k6_recommendations", "k7_cheapest_within_sla", "k9_recommendation_quality", "l1_streamed_runs",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("RUNLEDGER_ALL_QUERIES") else QUICK
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else None if value is None else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, database, name):
    df = contract.queries()[name](spark, DATA)
    expected = database.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def test_every_checking_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
