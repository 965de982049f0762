import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import labels
from runledger.operators import cleaning, enrich, gaps, regression
from runledger.plans import events
from runledger.session import shared_folder
from runledger.sources import generator, readers, sinks
from runledger.streaming import ingest


def vm_rows(spark, count):
    start = datetime(2026, 7, 24)
    rows = [
        ("centralindia", "Standard_D4ds_v4", 4, 16, 4, "3.5.1", "17", "10MB.csv", 10, "cpu", i, start + timedelta(minutes=i), 1.0 + i, 10.0, 0.01,
         "FAILED" if i == 3 else "SUCCESS")
        for i in range(1, count + 1)
    ]
    return spark.createDataFrame(rows, schemas.VM_RESULTS)


def test_snapshots_are_ingested_once(spark, tmp_path):
    """Three overlapping cumulative files, the last landing after the first run of the stream."""
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))

    def drain():
        ingest.ingest(ingest.result_stream(spark, landing, 1), table, checkpoint).awaitTermination()
        return spark.read.parquet(table)

    for n in (2, 4):
        sinks.write_csv(vm_rows(spark, n), f"{landing}/{n}")
    assert drain().count() == 4
    sinks.write_csv(vm_rows(spark, 6), f"{landing}/6")
    assert sorted(r.Run_Number for r in drain().collect()) == [1, 2, 3, 4, 5, 6]
    late = vm_rows(spark, 8).filter("Run_Number > 6").withColumn("Timestamp", F.expr("Timestamp - INTERVAL 400 DAYS"))
    sinks.write_csv(late.unionByName(late).unionByName(vm_rows(spark, 1)), f"{landing}/late")
    assert sorted(r.Run_Number for r in drain().collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    shutil.rmtree(f"{landing}/late")
    batch = readers.compact_snapshots(readers.read_result_drops(spark, landing))
    assert batch.count() == 6 and readers.latest_runs(readers.read_result_drops(spark, landing)).count() == 6


def test_ingest_reads_no_stored_run_and_writes_few_files(spark, tmp_path):
    """What is known doesn't come from the table: an archived batch stays known. Files don't follow the dates."""
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))

    def drain():
        ingest.ingest(ingest.result_stream(spark, landing, 1), table, checkpoint, files=2).awaitTermination()

    days = F.expr("Timestamp + make_interval(0, 0, 0, Run_Number)")
    sinks.write_csv(vm_rows(spark, 50).withColumn("Timestamp", days), f"{landing}/50")
    drain()
    assert spark.read.parquet(table).count() == 50
    assert all(len(list(folder.glob("*.parquet"))) <= 2 for folder in (tmp_path / "table").glob("batch=*"))
    shutil.move(table, str(tmp_path / "archive"))
    sinks.write_csv(vm_rows(spark, 53).withColumn("Timestamp", days), f"{landing}/53")
    drain()
    assert sorted(r.Run_Number for r in spark.read.parquet(table).collect()) == [51, 52, 53]
    assert all(len(list(folder.glob("*.parquet"))) <= 2 for folder in (tmp_path / "table").glob("batch=*"))


def test_enriched_stream_splits_and_can_be_repeated(spark, tmp_path):
    landing, table, failed = (str(tmp_path / n) for n in ("landing", "table", "failed"))
    sinks.write_csv(vm_rows(spark, 4), landing)
    prices = spark.createDataFrame([("centralindia", "Standard_D4ds_v4", "D4ds v4", 0.3)], "region string, machine_type string, tier string, price_usd_hr double")
    features = spark.createDataFrame([("azure", "centralindia", 600.0)], "cloud_key string, region_key string, carbon_intensity_mean double")
    enriched = ingest.enrich_runs(enrich.lowest_prices(prices, "azure"), features)
    for attempt in ("one", "two"):  # a new checkpoint replays batch 0
        ingest.split_sinks(ingest.result_stream(spark, landing), enriched, table, failed, str(tmp_path / attempt)).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert len(rows) == 3 and {r.carbon_intensity_mean for r in rows} == {600.0}
    assert [r.cost_usd for r in rows if r.run_number == 1] == [round(0.3 * 4 * 2.0 / 60, 6)]
    assert [(r.run_number, r.stage) for r in spark.read.parquet(failed).collect()] == [(3, "step")]


def test_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "lines.csv")
    spark.createDataFrame([("a,b",), ('"x, y",1',), ("z",), ("1,2,3",), ("q,text",)], "value string").coalesce(1).write.text(path)
    rows, rejected = readers.read_csv_split(spark, path, schemas.T.StructType().add("a", "string").add("b", "integer"))
    assert sorted((r.a, r.b) for r in rows.filter("b is not null or a in ('z', 'q')").fillna(-1).collect()) == [("q", -1), ("x, y", 1), ("z", -1)]
    assert [r.line for r in rejected.collect()] == ["1,2,3"]


def test_lookup_needs_its_columns(spark, tmp_path):
    path = str(tmp_path / "power")
    sinks.write_report_csv(spark.createDataFrame([("m", 2.0)], "machine_type string, watts double"), path)
    with pytest.raises(ValueError, match="power_w"):
        readers.read_lookup(spark, path, schemas.POWER, ["machine_type", "power_w"])


def test_append_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = spark.createDataFrame([(100.0, "cpu-heavy", "m5.xlarge", 2, 1.5, 0.01, "ap-south-1", "unit-test", "aws", "IN", None, None)], schemas.RUNS)
    for _ in range(2):
        sinks.append_rows(row, path, schemas.RUNS)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.columns == schemas.RUNS.names
    with pytest.raises(ValueError, match="nodes"):
        sinks.append_rows(row.withColumn("nodes", F.lit("2")), path, schemas.RUNS)


def test_report_csv_is_one_whole_file(spark, tmp_path):
    path = tmp_path / "r"
    sinks.write_report_csv(spark.range(5000, numPartitions=4), str(path))
    (part,) = path.glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0] == "id" and sorted(map(int, lines[1:])) == list(range(5000))


def test_job_metric_counts_while_writing(spark, tmp_path):
    row = sinks.write_measured(spark.range(37), str(tmp_path / "out"), "cpu-heavy", "in").first()
    assert (row.workload, row.rows) == ("cpu-heavy", 37)


def test_generated_events_are_in_bounds_and_repeatable(spark):
    made = generator.generate_events(spark.range(0, 20000, 1, 4))
    row = made.agg(
        F.min("payload_size").alias("a"), F.max("payload_size").alias("b"), F.min("response_time_ms").alias("c"), F.avg("response_time_ms").alias("d"),
        F.avg((F.col("amount_usd") > 0).cast("int")).alias("e"), F.avg((F.col("error_code") > 0).cast("int")).alias("f"),
        F.avg(F.when(F.col("amount_usd") > 0, F.col("amount_usd"))).alias("g"), F.percentile("payload_size", F.lit(0.5)).alias("h"),
    ).first()
    assert row.a >= 80 and row.b <= 5000 and row.c >= 5 and row.d == pytest.approx(180, abs=3)
    assert row.e == pytest.approx(0.15, abs=0.01) and row.f == pytest.approx(0.04, abs=0.01)
    assert row.g == pytest.approx(60, abs=3) and row.h == pytest.approx(403, rel=0.05)
    assert made.exceptAll(generator.generate_events(spark.range(0, 20000, 1, 4))).isEmpty()


def test_profile_rollup_equals_the_join(spark):
    log = generator.generate_events(spark.range(0, 4000, 1, 4)).withColumn("user_id", F.col("user_id") % 40 - 20)
    log = log.withColumn("response_time_ms", F.when(F.col("user_id") != 3, F.col("response_time_ms")))
    group = ["region", "event_type", "payload_bucket"]
    joined = events.bucketed_events(log).join(events.user_profiles(log), "join_key").groupBy(*group).agg(
        F.count(F.lit(1)).alias("events"), F.avg("user_avg_response").alias("a"), F.sum("user_revenue").alias("r")
    )
    both = joined.join(events.profile_rollup(log).withColumnRenamed("events", "n"), group, "full")
    off = (F.col("events") != F.col("n")) | (F.abs(F.col("a") - F.col("avg_profile_response")) > 1e-6) | (F.abs(F.col("r") - F.col("profile_revenue")) > 1e-4)
    assert both.filter(F.coalesce(off, F.lit(True)) & ~(F.col("a").isNull() & F.col("avg_profile_response").isNull())).isEmpty()


def test_cleaning_is_idempotent_and_reported(spark):
    columns = "dataset_size_mb string, workload_type string, machine_type string, nodes string, runtime_minutes string, cost_usd string, source string"
    good = ("10", " CPU-heavy", "M5.xlarge", "2", "1.5", "0.1", "s")
    rows = [good, good, ("10", "cpu-heavy", "m5.xlarge", "2.0", "1.5", "0.1", "s"), ("x", *good[1:]), (None, *good[1:]), ("10", "gpu", *good[2:]), (*good[:4], "1440", "0.1", "s")]
    raw = spark.createDataFrame(rows, columns)
    cleaned = cleaning.cleaned_runs(raw)
    assert cleaned.count() == 2 and cleaning.cleaned_runs(raw, unify_workloads=True).count() == 1
    assert cleaning.cleaned_runs(cleaned).count() == 1  # the two spellings are equal by now
    report = cleaning.cleaning_report(raw).first()
    assert (report.original_rows, report.duplicates_removed, report.null_rows_removed, report.final_rows) == (7, 1, 1, 2)


def test_retry_reasons_and_last_status(spark):
    campaign = spark.createDataFrame([(["r"], ["a", "b"], [2], [10], ["cpu"], 2)], "regions array<string>, vm_sizes array<string>, node_counts array<int>, dataset_sizes array<int>, workloads array<string>, repetitions int")
    t = datetime(2026, 1, 1)
    results = spark.createDataFrame(
        [("r", "a", 2, 10, "cpu", 1, t, "SUCCESS"), ("r", "a", 2, 10, "cpu", 1, t + timedelta(1), "FAILED")],
        "region string, vm_size string, nodes int, dataset_size_mb int, workload string, run_number int, timestamp timestamp, exit_status string",
    )
    status = spark.createDataFrame([("r", "b", 2, "SKIPPED", "needs 16 vCPU")], schemas.COMBO_STATUS)
    audit = {(r.vm_size, r.run_number): (r.passed, r.reason, r.retry) for r in gaps.audited_runs(gaps.expected_runs(campaign), results, status).collect()}
    assert audit == {
        ("a", 1): (False, "run FAILED", True), ("a", 2): (False, "never ran / missing", True),
        ("b", 1): (False, "SKIPPED: needs 16 vCPU", False), ("b", 2): (False, "SKIPPED: needs 16 vCPU", False),
    }
    won = gaps.audited_runs(gaps.expected_runs(campaign), results, status, success_wins=True).filter("passed").collect()
    assert [(r.vm_size, r.run_number) for r in won] == [("a", 1)]


def test_weighted_cells_fit_like_single_runs(spark):
    """Least squares on weighted means equals least squares on the runs."""
    rows = [("aws", "r", "z", float(s), w, "m", n, 400.0 + n, 20.0, s / 50 + n + 0.1 * k, 0.01 * s + k) for s in (10, 100, 500) for w in ("a", "b") for n in (2, 4) for k in range(3)]
    names = "cloud string, region string, electricity_zone string, dataset_size_mb double, workload_type string, machine_type string, nodes int, carbon_intensity_mean double, renewable_percentage_mean double, runtime_minutes double, cost_usd double"
    runs = spark.createDataFrame(rows, names)
    cells = regression.training_cells(regression.model_rows(runs))
    assert cells.count() == 12
    single = runs.withColumn("weight", F.lit(1.0))
    for model_type in ("linear_regression", "decision_tree"):
        a = regression.predict(regression.fit(cells, model_type), cells).orderBy(*regression.fv.FEATURES).collect()
        b = regression.predict(regression.fit(single, model_type), cells).orderBy(*regression.fv.FEATURES).collect()
        assert [r.predicted_runtime_minutes for r in a] == pytest.approx([r.predicted_runtime_minutes for r in b], abs=1e-3)


def test_split_keeps_groups_together(spark):
    rows = [("aws", "r", "z", float(g), "w", "m", 2, 1.0, 1.0, 1.0, 1.0) for g in range(20) for _ in range(3)]
    names = "cloud string, region string, electricity_zone string, dataset_size_mb double, workload_type string, machine_type string, nodes int, carbon_intensity_mean double, renewable_percentage_mean double, runtime_minutes double, cost_usd double"
    train, test = regression.holdout_split(spark.createDataFrame(rows, names))
    a, b = ({r[0] for r in part.select(labels.group_key(*regression.fv.GROUP)).collect()} for part in (train, test))
    assert not a & b and (len(a), len(b)) == (15, 5) and train.count() == 45


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rows_for_a_wanted_size(spark, tmp_path):
    path = tmp_path / "events"
    sinks.write_csv(generator.generate_events(spark.range(0, generator.rows_for_size(2), 1, 4)), str(path))
    written = sum(f.stat().st_size for f in path.glob("*.csv"))
    assert written == pytest.approx(2 * 1024 * 1024, rel=0.03)


def test_landed_and_shuffled_files_do_not_pile_up(spark, tmp_path):
    """Compressed snapshots; the files of a finished batch go when the next begins, its shuffle files when it ends."""
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in (str(x) for x in blocks.getAllBlocks().mkString(" ").split()) if b.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(ingest.CLEANUP)
    for n in (200, 400, 600):
        sinks.write_drop(vm_rows(spark, n).withColumn("source_file", F.lit(n)), landing, n, compressed=True)
        ingest.ingest(ingest.result_stream(spark, landing, done="delete"), table, checkpoint).awaitTermination()
    assert sorted(r.Run_Number for r in spark.read.parquet(table).collect()) == list(range(1, 601))
    assert {f.parent.name for f in (tmp_path / "landing").glob("*/part-*")} == {"drop=600"}
    assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "landing").glob("*/part-*"))
    waited = 0
    while shuffled() - before and waited < 100:
        time.sleep(0.1)
        waited += 1
    assert not shuffled() - before and spark.conf.get(ingest.CLEANUP) == setting
