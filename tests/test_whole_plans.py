"""Plans from end to end: a chosen and kept model, answers to every request, the dataset from raw tables."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.catalog import load, registry
from runledger.catalog.standins import Inputs, clear_shared
from runledger.operators import regression
from runledger.plans import model_dataset, recommend, training

DATA = "/root/testdata/sf0.001"
CONFIG = "workload_type string, cloud string, region string, machine_type string, nodes int, electricity_zone string, carbon_intensity_mean double, renewable_percentage_mean double"
SCORED = CONFIG + ", predicted_runtime_minutes double, predicted_cost_usd double, predicted_emissions_gco2eq double"
REQUESTS = "request_id string, workload_type string, dataset_size_mb double, sla_runtime_minutes double, goal string"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_best_by_cross_validation_is_refitted_and_kept(spark, tmp_path):
    clear_shared()
    dataset = Inputs(spark, DATA)("dataset")
    path = str(tmp_path / "chosen")
    name, models, report = training.choose_model(dataset, path, ["linear_regression", "decision_tree"], decision_tree={"maxDepth": 3})
    clear_shared()
    scores = {r["model"]: r["r2"] for r in report["folds"].groupBy("model").agg(F.avg("r2").alias("r2")).collect()}
    assert set(scores) == {"linear_regression", "decision_tree"} and name == max(scores, key=scores.get) == report["choice"].first()["model"]
    assert report["metrics"].count() == 4 and report["predictions"].select("model").distinct().count() == 2
    assert ("importances" in report) == (name == "decision_tree")
    assert sorted(os.listdir(path)) == sorted([*fv.TARGETS, "report"]) and sorted(os.listdir(f"{path}/report")) == sorted(report)
    cells = regression.training_cells(regression.model_rows(dataset)).select(*fv.FEATURES).limit(20)
    values = lambda m: sorted(tuple(r) for r in regression.predict(m, cells).collect())
    assert values(models) == values(regression.load(path))


def test_too_few_rows_choose_nothing(spark, tmp_path):
    schema = ", ".join([*(f"{c} {'double' if c in fv.NUMERIC else 'string'}" for c in fv.FEATURES), *(f"{t} double" for t in fv.TARGETS)])
    with pytest.raises(ValueError, match="at least"):
        training.choose_model(spark.createDataFrame([], schema), str(tmp_path / "none"))


def test_every_request_is_answered(spark):
    def candidate(workload, nodes, runtime, cost):
        return (workload, "AWS", "r", "m", nodes, "z", 100.0, 50.0, runtime, cost, 1.0)

    scored = spark.createDataFrame([
        candidate("cpu-heavy", 2, 5.0, 1.0), candidate("cpu-heavy", 4, 3.0, 2.0), candidate("cpu-heavy", 8, 1.0, None), candidate("io-heavy", 2, None, 1.0),
    ], SCORED)
    requests = spark.createDataFrame([
        ("fits", "cpu-heavy", 500.0, 4.0, "cost"), ("tight", "cpu-heavy", 500.0, 0.5, "cost"), ("free", "cpu-heavy", 500.0, None, "runtime"),
        ("none", "io-heavy", 500.0, 9.0, "cost"), ("other", "gpu-heavy", 500.0, 9.0, "carbon"), ("null", None, 500.0, 9.0, "cost"),
    ], REQUESTS)
    rows = recommend.answers(requests, scored, 5).orderBy("request_id", "rank").collect()
    found = [(r["request_id"], r["status"], r["rank"], r["nodes"], r["candidates"], r["unpredicted"]) for r in rows]
    assert found == [
        ("fits", "ok", 1, 4, 3, 1), ("free", "ok", 1, 4, 3, 1), ("free", "ok", 2, 2, 3, 1), ("none", "no_predicted_configuration", None, None, 1, 1),
        ("null", "unknown_workload", None, None, 0, 0), ("other", "unknown_workload", None, None, 0, 0),
        ("tight", "no_valid_configuration", 1, 2, 3, 1), ("tight", "no_valid_configuration", 2, 4, 3, 1),
    ]
    assert recommend.answers(requests.limit(0), scored).collect() == []
    assert {r["status"] for r in recommend.answers(requests, scored.limit(0)).collect()} == {"unknown_workload"}


@pytest.mark.parametrize(("basis", "azure"), [("regional_mean", (150.0, 2)), ("per_run", (200.0, 1))])
def test_dataset_from_raw_tables(spark, basis, azure):
    aws = spark.createDataFrame([(" ap-south-1 ", "CPU", "m5.xlarge", 500.0, 2, 60.0, 1.0)], "region string, workload_type string, instance_type string, dataset_size_mb double, nodes int, runtime_minutes double, cost_usd double")
    vm = spark.createDataFrame([
        ("centralindia", "Standard_D2s_v3", 2, 500, "io", datetime.datetime(2024, 1, 3), 30.0, 0.5, 9.0, "SUCCESS"), ("centralindia", "Standard_D2s_v3", 2, 500, "io", datetime.datetime(2024, 1, 3), 30.0, 0.5, 9.0, "FAILED"),
    ], "Region string, VM_Size string, Nodes int, Dataset_Size_MB int, Workload string, Timestamp timestamp, Runtime_Minutes double, Cost_USD double, CPU_Avg_Pct double, Exit_Status string")
    days = [("2024-01-01", "Azure", "Central India", "IN-WE", 100.0), ("2024-01-02", "azure", "central india", "IN-WE", 200.0), ("2024-01-01", "aws", "ap-south-1", "IN", 400.0), ("2024-01-09", "aws", "ap-south-1", "IN", 900.0)]
    place = "Date string, Cloud string, Region string, Electricity_Zone string"
    carbon = spark.createDataFrame(days, f"{place}, Carbon_Intensity_gCO2eq_per_kWh double")
    renewable = spark.createDataFrame([(*d[:4], 40.0) for d in days[:3]], f"{place}, Renewable_Percentage double")
    built = model_dataset.build_dataset(aws, vm, carbon, renewable, basis=basis)
    rows = {r["cloud"]: r for r in built["dataset"].collect()}
    assert built["dataset"].count() == 2
    assert (rows["Azure"]["carbon_intensity_mean"], rows["Azure"]["carbon_days_available"]) == azure and rows["Azure"]["estimated_emissions_gco2eq"] == azure[0] / 2
    assert (rows["AWS"]["carbon_intensity_mean"], rows["AWS"]["workload_type"], rows["AWS"]["region"], rows["AWS"]["machine_type"]) == (400.0, "cpu-heavy", "ap-south-1", "m5.xlarge")
    assert [tuple(r) for r in built["coarse_zones"].collect()] == [("IN", 1, "IN-WE")] and built["many_zones"].isEmpty()

_CHOICE = ["cloud", "region", "electricity_zone", "dataset_size_mb", "workload_type", "machine_type", "nodes", "carbon_intensity_mean", "renewable_percentage_mean", *fv.TARGETS]


class _Given:
    """Tables by name, in place of a folder's."""

    def __init__(self, spark, tables):
        self.spark, self.tables = spark, tables

    def __call__(self, name):
        return self.tables[name]


def test_every_model_takes_part_in_the_choice(spark, tmp_path, monkeypatch):
    """The registered choice: all four models are cross-validated and measured, and the best is refitted and scores every cell."""
    rows = [("aws", "r", f"z{z}", float(s), w, f"m{m}", n, 400.0 + z, 20.0, 1.0 + m + s / n, 0.1 * n + m) for z in (1, 2) for s in (10, 100, 500) for w in ("a", "b") for m in (1, 2) for n in (2, 4)]
    dataset = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in fv.CATEGORICAL else 'int' if c == 'nodes' else 'double'}" for c in _CHOICE))
    for model_type, setting in {"random_forest": {"numTrees": 6}, "gradient_boosting": {"maxIter": 4}}.items():
        monkeypatch.setitem(regression.SETTINGS, model_type, {**regression.SETTINGS[model_type], **setting})
    seen, choose = [], training.choose_model
    monkeypatch.setattr(training, "choose_model", lambda *a, **k: seen.append(choose(*a, **k)) or seen[-1])
    monkeypatch.setattr(registry, "Inputs", lambda spark, folder: _Given(spark, {"dataset": dataset}))
    found = sorted(tuple(r) for r in load()[0]["j5_chosen_and_saved"](spark, "none").collect())
    assert found == [("a", 24, 24, 1), ("b", 24, 24, 1)]
    name, _, report = seen[0]
    assert {r["model"] for r in report["folds"].select("model").distinct().collect()} == set(regression.LABELS)
    assert {r["model"] for r in report["predictions"].select("model").distinct().collect()} == set(regression.LABELS.values())
    assert report["metrics"].count() == 8 and report["averages"].count() == 4
    scores = {r["model"]: r["r2"] for r in report["folds"].groupBy("model").agg(F.avg("r2").alias("r2")).collect()}
    assert name == max(scores, key=scores.get)
