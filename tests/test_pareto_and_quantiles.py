import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.operators.pareto import flag_pareto, pareto_front, tradeoff
from runledger.operators.quantiles import exact_quantiles, quantiles

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "workload_type string, dataset_size_mb int, id int, cost_usd double, runtime_minutes double, emissions_gco2eq double"


def brute_front(rows):
    def dominated(a):
        return any(
            b[:2] == a[:2] and all(x <= y for x, y in zip(b[3:], a[3:])) and any(x < y for x, y in zip(b[3:], a[3:]))
            for b in rows
        )

    return {r[2] for r in rows if not dominated(r)}


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6), st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=120))
def test_front_is_the_undominated_rows(spark, points):
    rows = [(w, 1, i, float(c), float(r), float(e)) for i, (w, c, r, e) in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.id for r in pareto_front(df).collect()} == brute_front(rows)


def test_front_spanning_many_partitions(spark):
    """One scenario holds nearly all rows and most of them are on the front."""
    rng = np.random.default_rng(7)
    cost, runtime = rng.uniform(0, 1, 3000), rng.uniform(0, 1, 3000)
    emitted = np.round(2 - cost - runtime + rng.uniform(0, 0.05, 3000), 3)
    rows = [("a" if i else "b", 1, i, float(cost[i]), float(runtime[i]), float(emitted[i])) for i in range(3000)]
    objectives = np.column_stack([cost, runtime, emitted])[1:]
    expected = {0} | {
        i + 1 for i, p in enumerate(objectives) if not np.any(np.all(objectives <= p, axis=1) & np.any(objectives < p, axis=1))
    }
    found = {r.id for r in pareto_front(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert found == expected and len(found) > 200


def test_equal_points_all_stay_and_null_objectives_are_never_dominated(spark):
    rows = [("a", 1, 0, 1.0, 1.0, 1.0), ("a", 1, 1, 1.0, 1.0, 1.0), ("a", 1, 2, 2.0, 1.0, 1.0), ("a", 1, 3, None, 9.0, 9.0), ("a", 1, 4, 9.0, float("nan"), 9.0)]
    flags = {r.id: r.on_pareto_front for r in flag_pareto(spark.createDataFrame(rows, SCHEMA), ["id"]).collect()}
    assert flags == {0: True, 1: True, 2: False, 3: True, 4: True}


@FEW
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.floats(-5, 5, allow_nan=False).map(lambda v: round(v, 1))), min_size=1, max_size=150))
def test_quantiles_match_linear_interpolation(spark, pairs):
    df = spark.createDataFrame(pairs, "k string, v double")
    wanted = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert got == {r.k: r for r in quantiles(df, ["k"], "v", wanted).collect()}
    for k, group in pd.DataFrame(pairs, columns=["k", "v"]).groupby("k", dropna=False):
        for name, p in wanted.items():
            assert got[None if pd.isna(k) else k][name] == pytest.approx(np.quantile(group.v, p), abs=1e-9)


def test_quantiles_of_one_repeated_value_and_without_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    row = exact_quantiles(df, [], "v", {"low": 0.5, "high": 0.9}).first()
    values = np.array([7.0] * 4000 + list(range(4000, 5000)))
    assert (row.low, row.high) == (np.quantile(values, 0.5), pytest.approx(np.quantile(values, 0.9)))


def test_tradeoff_ties_go_to_the_smallest_configuration(spark):
    columns = "workload_type string, dataset_size_mb int, cloud string, region string, machine_type string, nodes int, electricity_zone string, cost_usd double, runtime_minutes double, emissions_gco2eq double"
    rows = [("w", 1, "b", "r", "m", 2, "z", 1.0, 5.0, 4.0), ("w", 1, "a", "r", "m", 2, "z", 1.0, 6.0, 8.0), ("w", 1, "c", "r", "m", 4, "z", 3.0, 1.0, 2.0)]
    row = tradeoff(spark.createDataFrame(rows, columns).repartition(3)).first()
    assert (row.cheapest, row.greenest, row.fastest) == ("a r m x2", "c r m x4", "c r m x4")
    assert (row.cost_penalty_of_greenest_pct, row.carbon_saving_of_greenest_pct, row.cheapest_is_greenest) == (200.0, 75.0, False)


def test_quantiles_of_many_rows_and_a_hot_key(spark):
    """60,000 of 61,000 rows share a key and a third of those one value."""
    rng = np.random.default_rng(11)
    values = np.where(rng.random(60000) < 0.33, 4.25, np.round(rng.normal(5, 2, 60000), 3))
    frame = pd.concat([pd.DataFrame({"k": "hot", "v": values}), pd.DataFrame({"k": "cold", "v": np.arange(1000.0)})])
    wanted = {"a": 0.0, "b": 0.25, "c": 0.4, "d": 0.5, "e": 0.99, "f": 1.0}
    df = spark.createDataFrame(frame).repartition(6)
    got = {r.k: r for r in quantiles(df, ["k"], "v", wanted).collect()}
    for k, group in frame.groupby("k"):
        assert [got[k][n] for n in wanted] == pytest.approx([np.quantile(group.v, p) for p in wanted.values()], abs=1e-9)
    whole = quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.quantile(frame.v, 0.5))
