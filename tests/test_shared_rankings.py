"""Rankings and summaries that never pair all rows."""

from runledger.operators import pareto, profile, scoring
from runledger.plans import recommend
from pyspark.sql import functions as F

RUNS = "workload_type string, dataset_size_mb int, machine_type string, nodes int, runtime_minutes double, cost_usd double"


def test_summary_lists_few_labels_and_counts_many(spark):
    runs = spark.createDataFrame([("w", i % 3, f"m{i}", i % 2, float(i), 1.0) for i in range(12)] + [(None, None, None, None, None, None)], RUNS)
    row = profile.dataset_summary(runs, listed=5).first()
    assert row["rows"] == 13 and row["dataset_sizes_mb"] == [0, 1, 2] and row["workloads"] == ["w"] and row["node_counts"] == [0, 1]
    assert row["machine_types"] is None and row["n_machine_types"] == 12 and row["n_dataset_sizes_mb"] == 3
    empty = profile.dataset_summary(runs.limit(0)).first()
    assert empty["rows"] == 0 and empty["workloads"] == [] and empty["n_workloads"] == 0


def test_corner_points_are_rows_that_nothing_dominates(spark):
    rows = [("a", float(x), float((7 * x) % 11), float((5 * x) % 13)) for x in range(40)] + [("b", 1.0, 1.0, 1.0), ("b", 2.0, 2.0, 2.0)]
    table = spark.createDataFrame(rows, "s string, x double, y double, z double")
    for row in pareto.corner_points(table, ["s"], ["x", "y", "z"]).collect():
        mine = [r[1:] for r in rows if r[0] == row["s"]]
        for corner in row["_corners"]:
            point = tuple(corner)
            strictly = [r for r in mine if all(a < b for a, b in zip(r, point, strict=True))]
            assert point in mine and not strictly
        assert len(row["_corners"]) <= len(pareto._DIRECTIONS)


def candidates(spark):
    rows = [("w", "aws", "r", f"m{i}", 1 + i % 3, "Z", 400.0 + i, 20.0 + i, float(1 + (3 * i) % 7), float((5 * i) % 9), 5.0 + i) for i in range(9)]
    return spark.createDataFrame(rows, "workload_type string, cloud string, region string, machine_type string, nodes int, electricity_zone string, carbon_intensity_mean double, renewable_percentage_mean double, predicted_runtime_minutes double, predicted_cost_usd double, predicted_emissions_gco2eq double")


def test_classes_stand_for_every_request(spark):
    scored = candidates(spark)
    asked = [(i, "w", 100.0, None if i % 5 == 0 else float(i % 9), goal) for i in range(40) for goal in ("cost", "balanced")]
    requests = spark.createDataFrame(asked, "request_id int, workload_type string, dataset_size_mb double, sla_runtime_minutes double, goal string")
    each = scoring.rank_candidates(requests.withColumn("request_id", F.concat_ws("-", "request_id", "goal")).join(scored, "workload_type"), ["request_id"])
    plain = each.groupBy("goal", "machine_type").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))
    shared = recommend.ranked_classes(requests, scored).groupBy("goal", "machine_type").agg(F.sum("requests").alias("n"), F.sum(F.col("rank") * F.col("requests")).alias("ranks"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, shared.collect()))


def test_cheapest_prefix_with_nulls_ties_and_repeats(spark):
    predictions = spark.createDataFrame(
        [("w", "a", 1, 10.0, 1.0), ("w", "b", 1, 5.0, 1.0), ("w", "c", 2, 5.0, 1.0), ("w", "d", 1, None, 1.0), ("w", "e", 1, 1.0, 1.0)],
        "workload_type string, instance_type string, nodes int, predicted_runtime_minutes double, model_predicted_cost_usd double",
    )
    priced = spark.createDataFrame([("a", 1, "general", 0.1), ("b", 1, "general", 6.0), ("c", 2, "general", 3.0), ("d", 1, "general", 0.01), ("e", 1, "general", None)], "instance_type string, nodes int, category string, hourly_price_usd double")
    requests = spark.createDataFrame([(1, "w", 5.0), (1, "w", 5.0), (2, "w", 20.0), (3, "w", 1.0), (4, "w", None), (5, "x", 5.0), (6, None, 5.0)], "request_id int, workload_type string, sla_runtime_minutes double")
    found = {r["request_id"]: (r["status"], r["candidates"], r["instance_type"]) for r in recommend.cheapest_within_sla(requests, priced, predictions).collect()}
    assert found == {
        1: ("ok", 5, "b"), 2: ("ok", 5, "a"), 3: ("no_valid_configuration", 5, "b"), 4: ("ok", 5, "a"),
        5: ("unknown_workload", 0, None), 6: ("unknown_workload", 0, None),
    }


def test_summary_lists_every_label(spark):
    """However many there are: the summary's lists are whole, in the order of their type, and as long as the counts."""
    many = 10_500
    sizes = F.when(F.col("id") % 2 == 0, (F.col("id") / 4).cast("int"))
    runs = spark.range(2 * many).select(
        F.lit("w").alias("workload_type"), sizes.alias("dataset_size_mb"), F.concat(F.lit("m"), F.col("id") % many).alias("machine_type"),
        (F.col("id") % 3).cast("int").alias("nodes"), (F.col("id") % 7).cast("double").alias("runtime_minutes"), F.lit(1.0).alias("cost_usd"),
    )
    row = profile.dataset_summary(runs).first()
    assert row["rows"] == 2 * many and row["workloads"] == ["w"] and row["node_counts"] == [0, 1, 2]
    assert row["machine_types"] == sorted(f"m{i}" for i in range(many)) and row["n_machine_types"] == many
    assert row["dataset_sizes_mb"] == list(range(many // 2)) and row["n_dataset_sizes_mb"] == many // 2
    assert tuple(row["runtime_minutes"]) == (0.0, 3.0, 6.0) and tuple(row["cost_usd"]) == (1.0, 1.0, 1.0)
    short = profile.dataset_summary(runs, listed=100).first()
    assert short["machine_types"] is None and short["n_machine_types"] == many and short["node_counts"] == [0, 1, 2]
    assert profile.label_counts(runs, ["machine_type"]).filter("rows = 2").count() == many
