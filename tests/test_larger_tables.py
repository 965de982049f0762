"""Steps whose sorts, spills or repeated scans grew with the table."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from runledger.catalog import load, model_queries
from runledger.operators import evaluation, quantiles, regression
from runledger.sources import sinks

NAMES = ["workload_type", "dataset_size_mb", "cloud", "region", "machine_type", "nodes", "electricity_zone", "runtime_minutes", "cost_usd", "carbon_intensity_mean", "renewable_percentage_mean"]


def runs(spark):
    times = [(3.0, 0.5), (2.0, 0.9), (2.0, 0.4), (2.0, 0.7), (5.0, 0.1)]
    rows = [
        (w, s, "aws", r, m, n, "z", t + 0.1 * n, c + (m == "b"), 300.0, 20.0)
        for w in ("cpu", "io") for s in (10.0, 100.0) for r in ("x", "y") for m in ("a", "b") for n in (2, 4) for t, c in times
    ]
    rows.append(("cpu", 10.0, "aws", "x", "a", 2, "z", 0.1, None, 300.0, 20.0))
    return spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'nodes' else 'string' if i in (0, 2, 3, 4, 6) else 'double'}" for i, n in enumerate(NAMES)))


def test_cells_find_the_fastest_run_without_sorting_runs(spark):
    found = evaluation.cells(runs(spark))
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()
    rows = found.collect()
    assert len(rows) == 32 and all(r["runs"] == 5 for r in rows)
    for r in rows:
        assert tuple(r["fastest_run"]) == (2.0 + 0.1 * r["nodes"], 0.4 + (r["machine_type"] == "b"))


def test_drops_are_written_without_a_sort_by_drop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrameWriter, "partitionBy", None)
    rows = spark.range(30).select("id", F.concat(F.lit("results-"), (F.col("id") % 3).cast("string"), F.lit(".csv")).alias("source_file"))
    sinks.write_drops(rows, f"{tmp_path}/drops")
    found = spark.read.option("header", True).csv(f"{tmp_path}/drops")
    assert sorted((int(r["id"]), r["drop"]) for r in found.collect()) == sorted((r["id"], r["source_file"]) for r in rows.collect())


def test_the_hold_out_is_written_and_scored_once_for_all_models(spark, monkeypatch):
    staged, stage = [], regression.stage
    monkeypatch.setattr(regression, "stage", lambda df, name="stage": (staged.append(name), stage(df, name))[1])
    found = regression.compare_models(runs(spark), ["linear_regression", "decision_tree"])
    assert staged.count("predictions") == 1 and staged.count("test-rows") == 1
    counts = {r["model"]: r["count"] for r in found["predictions"].groupBy("model").count().collect()}
    assert set(counts) == {"Linear Regression", "Decision Tree"} and len(set(counts.values())) == 1
    assert {(r["model"], r["target"]) for r in found["metrics"].collect()} == {(m, t) for m in ("linear_regression", "decision_tree") for t in ("runtime_minutes", "cost_usd")}


def test_a_snapshot_is_one_batch_however_many_files_it_has(spark, tmp_path, monkeypatch):
    lines = [(i, i % 5, i % 3, i % 7, float(i % 50), 100.0 * i, 0.01 * (i % 9), 0.0, "ANR"[i % 3], "O", datetime(1995 + i % 5, 3, 1 + i % 20)) for i in range(300)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in range(3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, i) for i in range(5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(model_queries, "new_path", lambda _, name: f"{tmp_path}/{name}")
    rows = load()[0]["l1_streamed_runs"](spark, str(tmp_path)).collect()
    assert sum(r["runs"] for r in rows) == 300 and sum(r["run_numbers"] for r in rows) == sum(i % 40 + 1 for i in range(300))
    assert len(list(tmp_path.glob("landing/*/*.csv"))) > 3 and len(list(tmp_path.glob("ingested/batch=*"))) == 3


def test_names_of_drops_come_in_order_with_null(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "source_file string")
    assert sinks.drop_names(rows) == [None, "a", "b"] and sinks.drop_names(rows.limit(0)) == []


def test_tied_values_are_not_moved_for_quantiles(spark, monkeypatch):
    """What many rows share is found from the counts; of the rest only the rows between the bounds of a quantile are sorted."""
    sorted_rows, placed = [], quantiles._placed
    monkeypatch.setattr(quantiles, "_placed", lambda values, keys: (sorted_rows.append(values.count()), placed(values, keys))[1])
    monkeypatch.setattr(quantiles, "_CHUNK", 5)
    monkeypatch.setattr(quantiles, "exact_quantiles", None)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}
    draw = np.random.default_rng(5)
    groups = {"two": draw.integers(0, 2, 20000) * 2.0 + 2, "fifty": draw.integers(1, 51, 20000) / 10, "many": np.round(draw.normal(0, 1, 20000), 3)}

    def check(names):
        rows = spark.createDataFrame([(k, float(v)) for k in names for v in groups[k]], "k string, v double").repartition(5)
        for r in quantiles.quantiles(rows, ["k"], "v", wanted).collect():
            assert [r[n] for n in wanted] == pytest.approx([np.quantile(groups[r["k"]], p) for p in wanted.values()], abs=1e-9)

    check(["two", "fifty"])
    assert sorted_rows == []
    check(groups)
    assert len(sorted_rows) == 1 and 20 < sorted_rows[0] < 400


def test_large_snapshots_land_compressed_and_go_once_ingested(spark, tmp_path, monkeypatch):
    """Of 120, 240 and 300 rows: the first lands as plain CSV, the others by gzip, and only the last is left."""
    lines = [(i, i % 5, i % 3, i % 7, float(i % 50), 100.0 * i, 0.01 * (i % 9), 0.0, "ANR"[i % 3], "O", datetime(1995 + i % 5, 3, 1 + i % 20)) for i in range(300)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in range(3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, i) for i in range(5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(model_queries, "new_path", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(sinks, "FILE_ROWS", 200)
    landed, write = [], sinks.write_drop
    monkeypatch.setattr(sinks, "write_drop", lambda *a, **k: (landed.append(k["compressed"]), write(*a, **k))[1])
    rows = load()[0]["l1_streamed_runs"](spark, str(tmp_path)).collect()
    assert sum(r["runs"] for r in rows) == 300 and sum(r["run_numbers"] for r in rows) == sum(i % 40 + 1 for i in range(300))
    left = list(tmp_path.glob("landing/*/part-*"))
    assert landed == [False, True, True] and {f.parent.name for f in left} == {"drop=results-3.csv"} and all(f.name.endswith(".csv.gz") for f in left)
    assert len(list(tmp_path.glob("ingested/batch=*"))) == 3
