"""Compare the models, choose one by cross-validation, refit it on all runs and keep it with its report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runledger import fixed_values as fv
from runledger.operators import regression
from runledger.session import stage


def choose_model(dataset: DataFrame, path: str, model_types: list[str] | None = None, folds: int = 5, **overrides: dict) -> tuple[str, regression.Models, dict[str, DataFrame]]:
    """(model type, fitted models, report); both are kept below `path`.

    The hold-out measures every model, but its one split varies too much to
    choose by: the model with the greatest mean R2 over the grouped folds (then
    the least RMSE) is refitted on all runs. regression.load(path) reads it
    back. The report's tables lie in path/report/<name>: predictions (actual and
    predicted targets of the hold-out), metrics, averages, folds, choice and,
    unless the model is linear, importances. overrides: model type -> settings.
    """
    rows = stage(regression.model_rows(dataset), "model-rows")
    if rows.limit(fv.MIN_MODEL_ROWS).count() < fv.MIN_MODEL_ROWS:
        raise ValueError(f"need at least {fv.MIN_MODEL_ROWS} rows")
    per_fold = stage(regression.cross_validate(rows, model_types, folds, **overrides), "folds")
    choice = stage(regression.best_model(per_fold), "choice")
    model_type = choice.first()["model"]
    cells = regression.training_cells(rows)
    models = regression.pipelines(cells, model_type, **overrides.get(model_type, {}))
    regression.save(models, path)
    tables = {**regression.compare_models(rows, model_types, **overrides), "folds": per_fold, "choice": choice}
    importances = regression.feature_importances(models, cells)
    if importances is not None:
        tables["importances"] = importances
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/report/{name}")
    read = rows.sparkSession.read
    return model_type, models, {n: read.schema(df.schema).parquet(f"{path}/report/{n}") for n, df in tables.items()}
