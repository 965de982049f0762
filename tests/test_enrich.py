from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels, measures
from runledger.operators import enrich
from runledger.plans import model_dataset

RUN = (
    "cloud string, region string, run_date date, dataset_size_mb double, workload_type string, machine_type string, nodes int, "
    "runtime_minutes double, cost_usd double"
)
DAILY = "cloud_key string, region_key string, electricity_zone string, reading_date date, carbon_intensity double, renewable_percentage double"


def run(day):
    return ("AWS", "ap-south-1", day, 100.0, "cpu-heavy", "m5.xlarge", 2, 1.0, 0.01)


def reading(day, intensity, renewable=20.0, region="ap-south-1"):
    return ("aws", region, "IN-WE", date(2025, 11, day), float(intensity), float(renewable))


def attached(spark, runs, daily, basis, mean=605.2):
    keyed = enrich.with_join_keys(spark.createDataFrame(runs, RUN))
    features = spark.createDataFrame(
        [("aws", "ap-south-1", "IN-WE", mean, 500.0, 700.0, 20.0, 10.0, 30.0, 365)],
        "cloud_key string, region_key string, electricity_zone string, carbon_intensity_mean double, carbon_intensity_min double, "
        "carbon_intensity_max double, renewable_percentage_mean double, renewable_percentage_min double, renewable_percentage_max double, "
        "carbon_days_available bigint",
    )
    return enrich.attach_carbon(keyed, spark.createDataFrame(daily, DAILY), features, basis).collect()


@pytest.mark.parametrize("daily, day, expected", [
    ([reading(1, 400), reading(5, 450, 25), reading(10, 500)], 5, 450.0),
    ([reading(1, 400), reading(5, 450)], 4, 450.0),
    ([reading(1, 400), reading(5, 450)], 3, 400.0),
    ([reading(1, 400, region="other")], 3, None),
])
def test_dated_runs_take_the_nearest_reading(spark, daily, day, expected):
    [row] = attached(spark, [run(date(2025, 11, day))], daily, "per_run")
    assert (row.carbon_intensity_mean, row.carbon_feature_source, row.carbon_days_available) == (expected, "nearest_daily_reading", 1)
    assert row.carbon_intensity_min is None


def test_undated_runs_and_the_default_basis_take_regional_means(spark):
    [row] = attached(spark, [run(None)], [], "per_run")
    assert (row.carbon_intensity_mean, row.carbon_feature_source) == (605.2, "regional_mean")
    [row] = attached(spark, [run(date(2025, 11, 5))], [reading(5, 450)], "regional_mean", mean=1000.0)
    assert (row.carbon_intensity_mean, row.carbon_feature_source) == (1000.0, "regional_mean")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 60), min_size=1, max_size=12), st.sets(st.integers(0, 60), min_size=1, max_size=12))
def test_nearest_reading_has_the_least_distance_and_ties_are_earlier(spark, days, read):
    start = date(2025, 1, 1)
    daily = spark.createDataFrame([("a", "r", "z", start + timedelta(d), float(d), 0.0) for d in read], DAILY)
    asked = spark.createDataFrame([("a", "r", start + timedelta(d)) for d in days], "cloud_key string, region_key string, day date")
    got = {(r.day - start).days: (r.reading_date - start).days for r in enrich.nearest_readings(asked, daily).collect()}
    assert got == {d: min(read, key=lambda x: (abs(x - d), x)) for d in days}


def test_run_cost_and_unpriced_machines(spark):
    prices = spark.createDataFrame([("ap-south-1", "m5.xlarge", "on-demand", 0.2), ("AP-SOUTH-1 ", "m5.xlarge", "OnDemand", 0.192)], "region string, machine_type string, tier string, price_usd_hr double")
    runs = spark.createDataFrame([("ap-south-1", "m5.xlarge", 2, 30.0, "on-demand"), ("ap-south-1", "c5.xlarge", 2, 30.0, "on-demand")], "region string, machine_type string, nodes int, runtime_minutes double, pricing_model string")
    lowest = enrich.lowest_prices(prices)
    costs = {r.machine_type: r.cost_usd for r in enrich.priced_runs(runs, lowest).collect()}
    assert costs == {"m5.xlarge": 0.192, "c5.xlarge": None}
    assert [r.machine_type for r in enrich.unpriced_runs(runs, lowest).collect()] == ["c5.xlarge"]


def test_labels(spark):
    def values(column, texts):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
        return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]

    assert values(labels.workload_label, ["cpu", "CPU", "memory", "io", "cpu-heavy"]) == ["cpu-heavy", "cpu-heavy", "memory-heavy", "io-heavy", "cpu-heavy"]
    assert values(labels.run_zone, ["ap-south-1", "AP-SOUTH-1", "ap-southeast-1", "eu-west-1"]) == ["IN", "IN", "SG", ""]
    assert values(labels.inferred_vcpus, ["Standard_D4s_v3", "Standard_D2as_v4", "m5.large", "c5.2xlarge", "unknown"]) == [4.0, 2.0, 2.0, 8.0, None]
    assert values(labels.region_name, ["CentralIndia", "ap-south-1"]) == ["Central India", "ap-south-1"]
    assert values(lambda c: labels.joined_reason(c, F.lit(""), F.lit("b")), ["a", None, "x" * 2000]) == ["a | b", "b", "x" * 1500]


def test_power_is_listed_else_inferred_else_default(spark):
    runs = spark.createDataFrame([("m5.xlarge",), ("c5.2xlarge",), ("mystery",)], "machine_type string")
    power = spark.createDataFrame([("m5.xlarge", 9.5, "published")], "machine_type string, power_w double, source string")
    got = {r.machine_type: (r.power_w, r.power_source, r.vcpus_unknown) for r in enrich.attach_power(runs, power).collect()}
    assert got == {"m5.xlarge": (9.5, "published", False), "c5.2xlarge": (96.0, "ESTIMATED from vCPU count", False), "mystery": (60.0, "ESTIMATED from vCPU count", True)}


def test_power_table_interpolates_over_architectures(spark):
    rows = [("Standard_D2as_v4", "Azure", 2, ["EPYC 2nd Gen"], "AMD"), ("Standard_D2ds_v4", "Azure", 2, ["Cascade Lake"], "Intel")]
    instances = spark.createDataFrame(rows, "machine_type string, provider string, vcpus int, architectures array<string>, note string")
    got = {r.machine_type: (r.power_w, r.watts_per_vcpu) for r in enrich.power_table(instances, enrich.watt_coefficients(spark)).collect()}
    assert got == {"Standard_D2as_v4": (2.17, 1.0836), "Standard_D2ds_v4": (4.61, 2.3031)}
    with pytest.raises(ValueError):
        enrich.power_table(instances, enrich.watt_coefficients(spark), 1.5)


def test_service_minutes_fall_back_to_the_span(spark):
    row = spark.range(1).select(
        measures.service_minutes(F.lit(60000), F.lit(30000), F.lit(None), F.lit(0), F.lit(0)).alias("phases"),
        measures.service_minutes(F.lit(None), F.lit(0), F.lit(0), F.lit(60000), F.lit(180000)).alias("span"),
        measures.service_minutes(F.lit(0), F.lit(0), F.lit(0), F.lit(9), F.lit(1)).alias("backwards"),
    ).first()
    assert (row.phases, row.span, row.backwards) == (1.5, 2.0, 0.0)


def test_feature_lists():
    assert sorted(fv.CATEGORICAL + fv.NUMERIC) == sorted(fv.FEATURES)
    assert not set(fv.CATEGORICAL) & set(fv.NUMERIC) and not set(fv.TARGETS) & set(fv.FEATURES)


def test_clouds_are_aligned(spark):
    aws = spark.createDataFrame([(100.0, "cpu", "m5.xlarge", 2, 1.0, 0.1, " ap-south-1 ")], "dataset_size_mb double, workload_type string, instance_type string, nodes int, runtime_minutes double, cost_usd double, region string")
    vm = spark.createDataFrame([("centralindia", "D4", 2, 10, "io", "2026-07-24T19:27:13+00:00", 1.0, 0.1, "SUCCESS"), ("centralindia", "D4", 2, 10, "io", "bad", 1.0, 0.1, "FAILED")], "Region string, VM_Size string, Nodes int, Dataset_Size_MB int, Workload string, Timestamp string, Runtime_Minutes double, Cost_USD double, Exit_Status string")
    rows = model_dataset.all_runs(model_dataset.aws_runs(aws), model_dataset.azure_runs(vm)).orderBy("cloud").collect()
    assert [(r.cloud, r.region, r.machine_type, r.workload_type, r.run_date) for r in rows] == [
        ("AWS", "ap-south-1", "m5.xlarge", "cpu-heavy", None), ("Azure", "Central India", "D4", "io-heavy", date(2026, 7, 24)),
    ]
