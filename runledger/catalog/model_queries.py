"""Training and evaluation of models, and the streaming operators.

Every model has the library's settings (regression.SETTINGS). The forests and
boosted trees of a query's folds, targets and scenarios are grown in one job.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.catalog.planning_queries import _FOLD, _PER_FOLD, per_fold
from runledger.catalog.registry import query
from runledger.catalog.relational_queries import rounded
from runledger.operators import enrich, evaluation, leave_out, regression, scoring, statistics
from runledger.plans import recommend, reports, training
from runledger.session import new_path, stage
from runledger.sources import readers, sinks
from runledger.streaming import ingest

_CELLS = "SELECT DISTINCT cloud, region, electricity_zone, dataset_size_mb, workload_type, machine_type, nodes FROM {dataset}"


def _cells(t):
    return regression.training_cells(regression.model_rows(t("dataset")))


@query("j1_feature_vectors", f"""
    SELECT workload_type, COUNT(*) AS cells, (SELECT COUNT(DISTINCT cloud) + COUNT(DISTINCT region) + COUNT(DISTINCT electricity_zone) + COUNT(DISTINCT workload_type) + COUNT(DISTINCT machine_type) + 4 FROM {{dataset}}) AS features,
      CAST(5 AS DOUBLE) AS known_ones, CAST(4 AS DOUBLE) AS ones_with_unseen_machine FROM ({_CELLS}) GROUP BY 1
""")
def _(t):
    cells = _cells(t)
    prepared = Pipeline(stages=regression.preprocessing()).fit(cells)

    def ones(df, name):
        """Ones among the label slots of the vector, the last four being numbers."""
        slots = vector_to_array("features")
        hot = F.aggregate(F.slice(slots, 1, F.size(slots) - 4), F.lit(0.0), lambda a, x: a + x)
        return prepared.transform(df).select("workload_type", F.size(slots).cast("bigint").alias("features"), hot.alias(name))

    known = ones(cells, "ones").groupBy("workload_type").agg(F.count(F.lit(1)).alias("cells"), F.max("features").alias("features"), F.avg("ones").alias("known_ones"))
    unseen = ones(cells.withColumn("machine_type", F.lit("new")), "ones").groupBy("workload_type").agg(F.avg("ones").alias("ones_with_unseen_machine"))
    return known.join(unseen, "workload_type")


@query("j2_four_regressors")
def _(t):
    cells = _cells(t)
    table = None
    for model_type in regression.LABELS:
        scored = regression.unclamped(regression.fit(cells, model_type), cells)
        rows = regression.long_predictions(scored).withColumn("model", F.lit(model_type))
        table = rows if table is None else table.unionByName(rows)
    return statistics.regression_metrics(table, ["model", "target"])


@query("j3_holdout_split", """
    SELECT part, COUNT(*) AS rows, COUNT(DISTINCT k) AS groups FROM (
      SELECT k, CASE WHEN dense_rank() OVER (ORDER BY ('0x' || substr(md5(k || '#42'), 1, 13))::UBIGINT) <= ceil(0.25 * (SELECT COUNT(DISTINCT (cloud, region, dataset_size_mb, workload_type, machine_type, nodes)) FROM {dataset})) THEN 'test' ELSE 'train' END AS part
      FROM (SELECT concat_ws('|', cloud, region, CAST(dataset_size_mb AS VARCHAR), workload_type, machine_type, CAST(nodes AS VARCHAR)) AS k FROM {dataset})) GROUP BY 1
""")
def _(t):
    train, test = regression.holdout_split(regression.model_rows(t("dataset")))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*fv.GROUP).alias("groups"))


def _validated(t):
    return t.shared("validated", lambda: regression.cross_validate(t("dataset")))


_FITTED = "(SELECT unnest(['linear_regression', 'decision_tree', 'random_forest', 'gradient_boosting']) AS model)"


@query("j4_cross_validation")
def _(t):
    return _validated(t)


@query("j4_validated_rows", f"SELECT model, fold, target, COUNT(*) AS n_test FROM (SELECT {_FOLD} AS fold FROM {{dataset}}), {_FITTED}, (SELECT unnest(['runtime_minutes', 'cost_usd']) AS target) GROUP BY 1, 2, 3")
def _(t):
    """Every run is tested once by every model, in its group's fold."""
    return _validated(t).filter("mae >= 0 AND rmse >= mae AND r2 <= 1").select("model", "fold", "target", "n_test")


@query("k10_fitted_models", f"""
    SELECT target, least(a.model, b.model) AS model_a, greatest(a.model, b.model) AS model_b, (SELECT COUNT(DISTINCT {_FOLD}) FROM {{dataset}}) AS folds
    FROM {_FITTED} a JOIN {_FITTED} b ON a.model < b.model, (SELECT unnest(['runtime_minutes', 'cost_usd']) AS target)
""")
def _(t):
    """The statistical report over the fitted models' folds: every pair is tested on all folds."""
    tests = reports.statistical_report(_validated(t), t("dataset"))["tests"]
    sound = F.col("ci95_lower") <= F.col("ci95_upper")
    return tests.filter(sound & F.col("paired_t_p_value").between(0, 1) & F.col("wilcoxon_p_value").between(0, 1)).select("target", "model_a", "model_b", "folds")


@query("j5_best_model", f"""
    WITH {_PER_FOLD} SELECT model, round(r2, 6) AS average_r2, round(rmse, 6) AS average_rmse FROM (
      SELECT model, AVG(r2) AS r2, AVG(rmse) AS rmse FROM (SELECT model, target, AVG(r2) AS r2, AVG(rmse) AS rmse FROM pf GROUP BY 1, 2) GROUP BY 1) ORDER BY r2 DESC, rmse LIMIT 1
""")
def _(t):
    return rounded(regression.best_model(per_fold(t)))


@query("j5_chosen_and_saved", f"SELECT workload_type, COUNT(*) AS cells, COUNT(*) AS scored, CAST(1 AS BIGINT) AS models FROM ({_CELLS}) GROUP BY 1")
def _(t):
    """The best of all four models, by cross-validation; read back, it scores every cell."""
    path = new_path(t.spark, "chosen")
    _, _, report = training.choose_model(t("dataset"), path)
    scored = regression.predict(regression.load(path), _cells(t).select(*fv.FEATURES))
    predicted = F.col("predicted_runtime_minutes").isNotNull() & F.col("predicted_cost_usd").isNotNull()
    counted = scored.groupBy("workload_type").agg(F.count(F.lit(1)).alias("cells"), F.count_if(predicted).alias("scored"))
    return counted.withColumn("models", report["choice"].groupBy().agg(F.countDistinct("model").alias("models")).scalar())


def _compared(t):
    return t.shared("compared", lambda: regression.compare_models(t("dataset"))["predictions"])


@query("j6_actual_and_predicted")
def _(t):
    return _compared(t)


@query("j6_tested_rows", """
    SELECT model, COUNT(*) AS rows, COUNT(DISTINCT k) AS groups, round(SUM(runtime_minutes), 3) AS minutes, round(SUM(cost_usd), 3) AS cost FROM (
      SELECT *, dense_rank() OVER (ORDER BY ('0x' || substr(md5(k || '#42'), 1, 13))::UBIGINT) AS place
      FROM (SELECT *, concat_ws('|', cloud, region, CAST(dataset_size_mb AS VARCHAR), workload_type, machine_type, CAST(nodes AS VARCHAR)) AS k FROM {dataset})),
      (SELECT unnest(['Linear Regression', 'Decision Tree', 'Random Forest', 'Gradient Boosting']) AS model)
    WHERE place <= ceil(0.25 * (SELECT COUNT(DISTINCT (cloud, region, dataset_size_mb, workload_type, machine_type, nodes)) FROM {dataset})) GROUP BY 1
""")
def _(t):
    """Every model is measured on the whole hold-out, each row once, with its own actual values."""
    predicted = F.col("predicted_runtime_minutes").isNotNull() & F.col("predicted_cost_usd").isNotNull()
    return _compared(t).filter(predicted).groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(*fv.GROUP).alias("groups"),
        F.round(F.sum("actual_runtime_minutes"), 3).alias("minutes"), F.round(F.sum("actual_cost_usd"), 3).alias("cost"),
    )


@query("j7_feature_importances")
def _(t):
    cells = _cells(t)
    return regression.feature_importances(regression.fit(cells, "decision_tree"), cells)


@query("h6_ranked_importances", f"SELECT target, CAST(n AS BIGINT) AS features, TRUE AS sums_to_one FROM (SELECT COUNT(DISTINCT cloud) + COUNT(DISTINCT region) + COUNT(DISTINCT electricity_zone) + COUNT(DISTINCT workload_type) + COUNT(DISTINCT machine_type) + 4 AS n FROM ({_CELLS})), (SELECT unnest(['runtime_minutes', 'cost_usd']) AS target)")
def _(t):
    cells = _cells(t)
    ranked = regression.feature_importances(regression.fit(cells, "decision_tree"), cells)
    return ranked.groupBy("target").agg(F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1) < 1e-3).alias("sums_to_one"))


@query("j8_batch_scoring", f"SELECT workload_type, COUNT(*) AS cells, CAST(0 AS BIGINT) AS below_limits FROM ({_CELLS}) GROUP BY 1")
def _(t):
    cells = _cells(t)
    scored = regression.predict(regression.fit(cells, "linear_regression"), cells.select(*fv.FEATURES))
    low = (F.col("predicted_runtime_minutes") < fv.MIN_RUNTIME) | (F.col("predicted_cost_usd") < 0)
    return scored.groupBy("workload_type").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.coalesce(low, F.lit(True))).alias("below_limits"))


def _model_recommendations(t, model_type):
    """Requests answered by a fitted model in place of the workload means."""
    runs = t("dataset")
    models = regression.fit(_cells(t), model_type)
    sizes = t("requests").select("workload_type", F.col("dataset_size_mb").cast("double").alias("dataset_size_mb")).distinct()
    scored = recommend.scored_candidates(runs, t("power"), t("vcpus"), lambda c: regression.predict(models, c.join(sizes, "workload_type")))
    requests = t("requests").withColumns({c: F.col(c).cast("double") for c in ("dataset_size_mb", "sla_runtime_minutes")})
    return scoring.report(recommend.recommend(requests, scored, 3))


def _model_quality(t, model_type, name):
    """Every scenario is judged by a model that was fitted without it."""
    runs = t("dataset")
    left_out = regression.left_out_predictions(runs, model_type, name)
    detail = evaluation.quality_detail(runs, {name: stage(left_out, "left-out")})
    return evaluation.quality_summary(detail, [name])


@query("j8_model_recommendations")
def _(t):
    return _model_recommendations(t, "linear_regression")


@query("j8_tree_recommendations")
def _(t):
    return _model_recommendations(t, "decision_tree")


@query("j8_forest_recommendations")
def _(t):
    return _model_recommendations(t, "random_forest")


@query("j8_boosting_recommendations")
def _(t):
    return _model_recommendations(t, "gradient_boosting")


@query("j9_model_quality")
def _(t):
    return _model_quality(t, "linear_regression", "linear")


@query("j9_tree_quality")
def _(t):
    return _model_quality(t, "decision_tree", "tree")


@query("j9_forest_quality")
def _(t):
    return _model_quality(t, "random_forest", "forest")


@query("j9_boosting_quality")
def _(t):
    return _model_quality(t, "gradient_boosting", "boosting")


_CELL_MEANS = "(SELECT cloud, region, electricity_zone, dataset_size_mb, workload_type, machine_type, nodes, COUNT(*) AS n, AVG(runtime_minutes) AS rt, AVG(cost_usd) AS cost FROM {dataset} GROUP BY 1, 2, 3, 4, 5, 6, 7)"


@query("j9_left_out_equations", f"""
    SELECT workload_type, dataset_size_mb, target, runs, round(value / runs, 6) AS mean_target, round(value / runs, 6) AS mean_predicted FROM (
      SELECT s.workload_type, s.dataset_size_mb, CAST(t.n - s.n AS DOUBLE) AS runs, unnest(['runtime_minutes', 'cost_usd']) AS target, unnest([t.rt - s.rt, t.cost - s.cost]) AS value
      FROM (SELECT workload_type, dataset_size_mb, SUM(n) AS n, SUM(n * rt) AS rt, SUM(n * cost) AS cost FROM {_CELL_MEANS} GROUP BY 1, 2) s,
        (SELECT SUM(n) AS n, SUM(n * rt) AS rt, SUM(n * cost) AS cost FROM {_CELL_MEANS}) t)
""")
def _(t):
    """The first normal equation of every scenario's linear models: they predict the mean of the runs that they were fitted to."""
    cells = _cells(t)
    solved = leave_out.linear_coefficients(cells, regression.fit(cells, "linear_regression"), fv.SCENARIO)
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("target"), F.round(f"mean_{c}", 6).alias("mean_target"), F.round(f"mean_predicted_{c}", 6).alias("mean_predicted")) for c in fv.TARGETS
    ]))
    return solved.select(*fv.SCENARIO, F.round("runs", 6).alias("runs"), each.alias("_e")).select(*fv.SCENARIO, "runs", "_e.*")


@query("j10_single_model")
def _(t):
    return regression.train(t("dataset"), "decision_tree", new_path(t.spark, "model"))[1]


# ---------------------------------------------------------------------------
# Streaming: the result files land, all present files are processed, the query ends.
# ---------------------------------------------------------------------------


@query("l1_streamed_runs", """
    SELECT Region, VM_Size, Workload, COUNT(*) AS runs, CAST(SUM(Run_Number) AS BIGINT) AS run_numbers
    FROM (SELECT DISTINCT Region, VM_Size, Nodes, Dataset_Size_MB, Workload, Run_Number, Timestamp FROM {vm_results}) GROUP BY 1, 2, 3
""")
def _(t):
    """Cumulative snapshots land one after the other; each is a batch, however many files it has, so that all cores share it.

    What lands is plain CSV and stays, as long as snapshots are small; one of over FILE_ROWS rows lands compressed,
    and the files ingested before it are removed.
    """
    landing, table, checkpoint = (new_path(t.spark, n) for n in ("landing", "ingested", "checkpoint"))
    snapshots = t("snapshots")
    for name in sinks.drop_names(snapshots):
        large = snapshots.filter(F.col("source_file").eqNullSafe(F.lit(name))).limit(sinks.FILE_ROWS + 1).count() > sinks.FILE_ROWS
        sinks.write_drop(snapshots, landing, name, compressed=large)
        results = ingest.result_stream(t.spark, landing, done="delete" if large else "off")
        ingest.ingest(results, table, checkpoint, files=t.spark.sparkContext.defaultParallelism).awaitTermination()
    return t.spark.read.schema(readers.schemas.VM_RESULTS).parquet(table).groupBy("Region", "VM_Size", "Workload").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("Run_Number").alias("run_numbers")
    )


_VM_PRICES = """
    SELECT DISTINCT Region AS region, VM_Size AS machine_type, 'D v3' AS tier, 0.1 * vCPU AS price_usd_hr FROM {vm_results} WHERE VM_Size <> 'Standard_D2as_v4'
    UNION ALL SELECT DISTINCT Region, VM_Size, 'D v3 Spot', 0.01 FROM {vm_results}
"""
_VM_CARBON = "SELECT 'azure' AS cloud_key, lower(Region) AS region_key, round(AVG(CPU_Avg_Pct), 6) AS carbon_intensity_mean FROM {vm_results} GROUP BY 2"


@query("l2_streamed_enrichment", f"""
    SELECT CASE WHEN Exit_Status <> 'SUCCESS' THEN 'step' WHEN p.price_usd_hr IS NULL THEN 'cost' ELSE 'stored' END AS outcome, v.Region AS region, COUNT(*) AS runs, round(SUM(p.price_usd_hr * Nodes * (Runtime_Minutes / 60.0)), 2) AS cost, round(MAX(c.carbon_intensity_mean), 4) AS intensity
    FROM {{vm_results}} v LEFT JOIN (SELECT * FROM ({_VM_PRICES}) WHERE tier = 'D v3') p ON v.Region = p.region AND v.VM_Size = p.machine_type LEFT JOIN ({_VM_CARBON}) c ON lower(v.Region) = c.region_key GROUP BY 1, 2
""")
def _(t):
    folder, table, failed = (new_path(t.spark, n) for n in ("landing", "stored", "failed"))
    sinks.write_csv(t("vm_results"), folder)
    lowest = stage(enrich.lowest_prices(t.sql(_VM_PRICES), "azure"))
    enriched = ingest.enrich_runs(lowest, stage(t.sql(_VM_CARBON)))
    ingest.split_sinks(ingest.result_stream(t.spark, folder), enriched, table, failed, new_path(t.spark, "checkpoint")).awaitTermination()
    columns = ["outcome", "region", "cost_usd", "carbon_intensity_mean"]
    stored = t.spark.read.parquet(table).withColumn("outcome", F.lit("stored")).select(*columns)
    rest = t.spark.read.parquet(failed).withColumnRenamed("stage", "outcome").select(*columns)
    return stored.unionByName(rest).groupBy("outcome", "region").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("cost_usd"), 2).alias("cost"), F.round(F.max("carbon_intensity_mean"), 4).alias("intensity")
    )


