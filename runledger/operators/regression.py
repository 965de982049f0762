"""Runtime and cost models with Spark ML.

Runs that repeat a configuration share all features, so models are fitted on
one weighted row per distinct feature vector: for squared error that gives the
same least-squares and tree fits as the single runs, on far fewer rows. Forests
and boosted trees over few such rows are grown side by side (ensembles.py).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import measures
from runledger.functions.labels import group_key
from runledger.operators import cleaning, ensembles, leave_out, statistics
from runledger.operators.quantiles import exact_quantiles
from runledger.session import stage

LABELS = {
    "linear_regression": "Linear Regression", "decision_tree": "Decision Tree",
    "random_forest": "Random Forest", "gradient_boosting": "Gradient Boosting",
}
# Settings of the four regressors. Depth 30 is the deepest that Spark ML allows.
SETTINGS = {
    "linear_regression": {"regParam": 1e-6, "solver": "normal"},
    "decision_tree": {"maxDepth": 30, "maxBins": 128, "seed": 42},
    "random_forest": {"numTrees": 250, "maxDepth": 30, "maxBins": 128, "featureSubsetStrategy": "all", "seed": 42},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "maxBins": 128, "seed": 42},
}
_ESTIMATORS = {
    "linear_regression": LinearRegression, "decision_tree": DecisionTreeRegressor,
    "random_forest": RandomForestRegressor, "gradient_boosting": GBTRegressor,
}
LINEAR = ("linear", "linear_regression")
Models = dict[str, PipelineModel]


def preprocessing() -> list:
    """One-hot labels (unseen ones all zero) and standardised numbers."""
    indexed = [f"{c}_index" for c in fv.CATEGORICAL]
    encoded = [f"{c}_onehot" for c in fv.CATEGORICAL]
    return [
        StringIndexer(inputCols=fv.CATEGORICAL, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=fv.NUMERIC, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=[*encoded, "scaled"], outputCol="features"),
    ]


def model_rows(dataset: DataFrame) -> DataFrame:
    """Complete rows of features and targets."""
    return cleaning.complete_cases(dataset, [*fv.FEATURES, *fv.TARGETS])


def training_cells(rows: DataFrame) -> DataFrame:
    """Distinct feature vectors with their number of runs and mean targets."""
    cells = rows.groupBy(*fv.FEATURES).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), *[F.avg(t).alias(t) for t in fv.TARGETS]
    )
    return stage(cells, "training")


def estimator(model_type: str, target: str, **overrides):
    if model_type == "linear":
        model_type = "linear_regression"
    if model_type not in _ESTIMATORS:
        raise ValueError(f"unknown model type: {model_type}")
    settings = {**SETTINGS[model_type], **overrides}
    return _ESTIMATORS[model_type](
        featuresCol="features", labelCol=target, weightCol="weight", predictionCol=f"predicted_{target}", **settings
    )


def _tasks(df: DataFrame) -> int:
    """Tasks of a training pass: the trees make many passes over few rows, so every core takes part."""
    return df.sparkSession.sparkContext.defaultParallelism


class Ensembles(dict):
    """A forest or boosted trees per target, grown where rows are scored. As a dictionary it holds Spark ML's pipelines, fitted when asked for."""

    def __init__(self, cells: DataFrame, model_type: str, overrides: dict) -> None:
        super().__init__()
        self.cells, self.model_type, self.overrides = cells, model_type, overrides

    def items(self):
        if not len(self):
            self.update(pipelines(self.cells, self.model_type, **self.overrides))
        return super().items()

    def scored(self, features: DataFrame) -> DataFrame:
        found = ensembles.scores(self.cells, features, self.model_type, {**SETTINGS[self.model_type], **self.overrides})
        return features.join(found, fv.FEATURES).select(*features.columns, *[f"predicted_{t}" for t in fv.TARGETS])


def fit(cells: DataFrame, model_type: str, **overrides) -> Models:
    """A model per target. Ensembles of few cells are grown where they are used, beside others; the rest is fitted here."""
    if model_type in ("random_forest", "gradient_boosting") and cells.limit(ensembles.GROUP_CELLS + 1).count() <= ensembles.GROUP_CELLS:
        return Ensembles(cells, model_type, overrides)
    return pipelines(cells, model_type, **overrides)


def pipelines(cells: DataFrame, model_type: str, **overrides) -> Models:
    """One fitted pipeline per target; the preprocessing is fitted once for both."""
    prepared = Pipeline(stages=preprocessing()).fit(cells)
    spread = prepared.transform(cells).select("features", "weight", *fv.TARGETS).repartition(_tasks(cells))
    ready = spread.persist()
    try:
        with ThreadPoolExecutor(len(fv.TARGETS)) as pool:
            fits = {t: pool.submit(inheritable_thread_target(cells.sparkSession)(estimator(model_type, t, **overrides).fit), ready) for t in fv.TARGETS}
            fitted = {t: f.result() for t, f in fits.items()}
    finally:
        ready.unpersist()
    return {t: PipelineModel(stages=[*prepared.stages, m]) for t, m in fitted.items()}


def predict(models: Models, features: DataFrame) -> DataFrame:
    """features with clamped predictions of runtime and cost."""
    return clamped(unclamped(models, features))


def clamped(predicted: DataFrame) -> DataFrame:
    return predicted.withColumns({
        "predicted_runtime_minutes": measures.clamped_runtime(F.col("predicted_runtime_minutes")),
        "predicted_cost_usd": measures.clamped_cost(F.col("predicted_cost_usd")),
    })


def unclamped(models: Models, features: DataFrame) -> DataFrame:
    if isinstance(models, Ensembles):
        return models.scored(features)
    keep = features.columns
    out = features
    for target, model in models.items():
        scored = model.transform(out)
        out = scored.select(*keep, *[c for c in scored.columns if c.startswith("predicted_") and c not in keep])
    return out


def predicted_rows(rows: DataFrame, models: Models) -> DataFrame:
    """Rows with predictions; each distinct feature vector is scored once."""
    scored = stage(unclamped(models, rows.select(*fv.FEATURES).distinct()), "predictions")
    return rows.join(scored, fv.FEATURES)


def holdout_split(rows: DataFrame, fraction: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): ceil(fraction x groups) whole groups go to the test side, chosen by hash.

    The hash below which a group is in the test side is a quantile of the
    hashes of the distinct groups, so no global ranking is made. With fewer
    than two groups single rows are split.
    """
    if fraction is None:
        fraction = 0.25 if rows.count() >= 12 else 0.34
    group = group_key(*fv.GROUP)
    position = F.conv(F.substring(F.md5(F.concat(group, F.lit(f"#{seed}"))), 1, 13), 16, 10).cast("double")
    placed = rows.withColumn("_position", position)
    groups = placed.select("_position").distinct()
    count = groups.count()
    if count < 2:
        test = F.rand(seed) < fraction
        marked = stage(rows.withColumn("_test", test), "split")
    else:
        wanted = min(math.ceil(fraction * count), count - 1)
        limit = exact_quantiles(groups, [], "_position", {"limit": (wanted - 0.5) / (count - 1)})
        marked = placed.withColumn("_test", F.col("_position") <= limit.select("limit").scalar()).drop("_position")
    return marked.filter("not _test").drop("_test"), marked.filter("_test").drop("_test")


def long_predictions(predicted: DataFrame, *keys: str) -> DataFrame:
    """(keys, target, actual, predicted) rows for the metric operators."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"), F.col(f"predicted_{t}").alias("predicted"))
        for t in fv.TARGETS
    ]))
    return predicted.select(*keys, pairs.alias("_p")).select(*keys, "_p.*")


def prediction_comparison(predicted: DataFrame, label: Column) -> DataFrame:
    """Actual and predicted targets of the test rows, under their model's label."""
    return predicted.select(
        label.alias("model"), "cloud", "region", "dataset_size_mb", "workload_type", "machine_type", "nodes",
        F.col("runtime_minutes").alias("actual_runtime_minutes"), "predicted_runtime_minutes",
        F.col("cost_usd").alias("actual_cost_usd"), "predicted_cost_usd",
    )


def feature_importances(models: Models, sample: DataFrame) -> DataFrame | None:
    """Importance of each feature per target, greatest first; None for linear models."""
    spark = sample.sparkSession
    rows = []
    for target, model in models.items():
        regressor = model.stages[-1]
        if not hasattr(regressor, "featureImportances"):
            return None
        described = PipelineModel(stages=model.stages[:-1]).transform(sample.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
        names = {a["idx"]: a.get("name", str(a["idx"])) for group in described.values() for a in group}
        weights = regressor.featureImportances.toArray()
        rows += [(target, names[i].replace("_onehot_", "_"), round(float(w), 6)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "target string, feature string, importance double").orderBy(
        "target", F.desc("importance"), "feature"
    )


def _in_parallel(spark, work, items: list, parallelism: int) -> list:
    """work(item) for every item, a few at a time: one small fit does not fill a cluster."""
    task = inheritable_thread_target(spark)(work)
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(task, items))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def cross_validate(dataset: DataFrame, model_types: list[str] | None = None, folds: int = 5, parallelism: int = 4, **overrides: dict) -> DataFrame:
    """MAE, RMSE and R2 per model, fold and target under grouped folds.

    A fold holds whole groups, so a cell (distinct feature vector) lies in one
    fold: the cells are built once, each fit takes those of the other folds and
    scores its own; the linear folds come from sums (leave_out.py). The runs are
    only read to be measured, against all folds' and models' scores in one join.
    """
    rows = model_rows(dataset)
    effective = statistics.fold_count(rows, folds).first()["folds"]
    marked = statistics.with_folds(rows, effective)
    cells = stage(
        marked.groupBy("fold", *fv.FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"), *[F.avg(t).alias(t) for t in fv.TARGETS]), "fold-cells"
    )

    def scores(item: tuple[int, str]) -> DataFrame:
        fold, model_type = item
        models = fit(cells.filter(F.col("fold") != fold), model_type, **overrides.get(model_type, {}))
        return unclamped(models, cells.filter(F.col("fold") == fold).select("fold", *fv.FEATURES)).withColumn("model", F.lit(model_type))

    wanted, summed = list(model_types or LABELS), []
    for model_type in [m for m in wanted if m in LINEAR]:
        whole = fit(cells, model_type, **overrides.get(model_type, {}))
        if leave_out.solvable(whole):
            wanted.remove(model_type)
            summed.append(leave_out.linear_predictions(cells, whole, ["fold"]).withColumn("model", F.lit(model_type)))
    items = [(fold, m) for fold in range(1, effective + 1) for m in wanted]
    scored = stage(_union([*summed, *_in_parallel(dataset.sparkSession, scores, items, parallelism)]), "fold-scores")
    measured = marked.join(scored, ["fold", *fv.FEATURES])
    return statistics.regression_metrics(long_predictions(measured, "fold", "model"), ["model", "fold", "target"])


def best_model(per_fold: DataFrame) -> DataFrame:
    """The model with the greatest mean R2 over the targets, then the least RMSE."""
    scores = per_fold.groupBy("model", "target").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
    scores = scores.groupBy("model").agg(F.avg("r2").alias("average_r2"), F.avg("rmse").alias("average_rmse"))
    return scores.agg(F.max(F.struct("average_r2", (-F.col("average_rmse")).alias("less_rmse"), "model")).alias("b")).select(
        "b.model", "b.average_r2", (-F.col("b.less_rmse")).alias("average_rmse")
    )


def compare_models(dataset: DataFrame, model_types: list[str] | None = None, **overrides: dict) -> dict[str, DataFrame]:
    """Hold-out metrics, averages and actual-against-predicted rows of every model.

    The hold-out is written once, and its distinct feature vectors are scored by
    every model; one join gives each run all models' predictions.
    """
    train, test = holdout_split(stage(model_rows(dataset), "model-rows"))
    test = stage(test, "test-rows")
    cells = training_cells(train)
    vectors = stage(test.select(*fv.FEATURES).distinct(), "test-vectors")
    wanted = model_types or list(LABELS)
    scores = [unclamped(fit(cells, m, **overrides.get(m, {})), vectors).withColumn("model", F.lit(m)) for m in wanted]
    predicted = test.join(stage(_union(scores), "predictions"), fv.FEATURES)
    metrics = stage(statistics.regression_metrics(long_predictions(predicted, "model"), ["model", "target"]), "metrics")
    comparison = prediction_comparison(predicted, F.coalesce(*[F.when(F.col("model") == m, F.lit(LABELS[m])) for m in wanted]))
    return {"predictions": comparison, "metrics": metrics, "averages": statistics.average_metrics(metrics, ["model"])}


def train(dataset: DataFrame, model_type: str, path: str | None = None, **overrides) -> tuple[Models, DataFrame]:
    """Measure one model on the hold-out, then refit it on all rows and save it."""
    rows = stage(model_rows(dataset), "model-rows")
    if rows.limit(fv.MIN_MODEL_ROWS).count() < fv.MIN_MODEL_ROWS:
        raise ValueError(f"need at least {fv.MIN_MODEL_ROWS} rows")
    train_rows, test_rows = holdout_split(rows)
    predicted = predicted_rows(test_rows, fit(training_cells(train_rows), model_type, **overrides))
    metrics = statistics.regression_metrics(long_predictions(predicted), ["target"])
    final = fit(training_cells(rows), model_type, **overrides)
    if path:
        save(final, path)
    return final, metrics


def save(models: Models, path: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{path}/{target}")


def load(path: str) -> Models:
    return {t: PipelineModel.load(f"{path}/{t}") for t in fv.TARGETS}


def left_out_predictions(dataset: DataFrame, model_type: str, name: str | None = None, parallelism: int = 4, **overrides) -> DataFrame:
    """Predictions for every configuration of each scenario from a model fitted without that scenario.

    Linear models of all scenarios are solved from sums in a fixed number of
    jobs. The others take one pair of fits per scenario: the few labels and
    sizes that were measured, read from the collapsed cells.
    """
    name = name or model_type
    cells = training_cells(model_rows(dataset))
    if model_type in LINEAR:
        whole = fit(cells, model_type, **overrides)
        if leave_out.solvable(whole):
            return _first_zones(clamped(leave_out.linear_predictions(cells, whole, fv.SCENARIO)), name)
    scenarios = [tuple(row) for row in cells.select(*fv.SCENARIO).distinct().toLocalIterator()]

    def scenario_predictions(scenario: tuple) -> DataFrame:
        inside = (F.col("workload_type") == scenario[0]) & (F.col("dataset_size_mb") == scenario[1])
        models = fit(cells.filter(~inside), model_type, **overrides)
        return predict(models, cells.filter(inside).select(*fv.FEATURES))

    return _first_zones(stage(_union(_in_parallel(dataset.sparkSession, scenario_predictions, scenarios, parallelism)), "left-out"), name)


def _first_zones(predicted: DataFrame, name: str) -> DataFrame:
    """One prediction for each configuration of a scenario: its first zone's."""
    return predicted.groupBy(*fv.SCENARIO, *fv.CONFIG).agg(
        F.min(F.struct("electricity_zone", "predicted_runtime_minutes", "predicted_cost_usd")).alias("_p")
    ).select(
        *fv.SCENARIO, *fv.CONFIG,
        F.col("_p.predicted_runtime_minutes").alias(f"{name}_runtime"), F.col("_p.predicted_cost_usd").alias(f"{name}_cost"),
    )
