"""Linear models of every left-out group from one pass over the cells.

A least-squares fit needs only sums of products of features and targets. Each
group's own sums are one aggregation of the products that aren't zero (a cell
has one slot a label, so few), combined in the map tasks; what remains without a
group is the total less its own sums, and each group's small system is solved in
the executors. So the number of jobs doesn't depend on the number of groups.

The total, a table of features x features, is sent to the tasks: FEATURES bounds
it to 8 MB. The features are those of a model fitted to all cells, standardised,
so that subtracting loses no digits; labels that only the left-out group has get
no weight, as unseen ones. The systems are those of Spark ML's normal solver
(features and targets scaled to the remaining cells, ridge without intercept).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import fixed_values as fv
from runledger.session import stage

#: Features of a model whose sums of products are sent to the tasks.
FEATURES = 1000


def solvable(models: dict[str, PipelineModel]) -> bool:
    """Whether the models are ridge or plain least squares with an intercept, of few enough features."""
    last = [m.stages[-1] for m in models.values()]
    return all(
        isinstance(m, LinearRegressionModel) and m.getElasticNetParam() == 0 and m.getFitIntercept() and m.getStandardization() and m.numFeatures <= FEATURES for m in last
    )


def _prepared(models: dict[str, PipelineModel], cells: DataFrame) -> DataFrame:
    prepared = PipelineModel(stages=next(iter(models.values())).stages[:-1]).transform(cells)
    return prepared.select(*cells.columns, vector_to_array("features").alias("_x"))


def _products(slots: Column, weight: Column) -> Column:
    """(i, j, s) for the pairs i <= j of slots that aren't zero."""
    filled = F.filter(F.transform(slots, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e.v != 0)
    row = lambda a: F.transform(F.filter(filled, lambda b: b.i >= a.i), lambda b: F.struct(a.i.alias("i"), b.i.alias("j"), (a.v * b.v * weight).alias("s")))
    return F.flatten(F.transform(filled, row))


def _system(total: np.ndarray, own: np.ndarray, features: int, ridge: dict[str, float]) -> dict | None:
    """Intercept and coefficients of each target without the own sums; None if nothing remains."""
    rest, one = total - own, features
    runs = rest[one, one]
    if runs <= 1e-9 * total[one, one]:
        return None
    mean = rest[:features, one] / runs
    covariance = rest[:features, :features] / runs - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    # Slots that no remaining cell has keep the dust of the subtraction.
    used = np.flatnonzero(spread > 1e-7)
    matrix = covariance[np.ix_(used, used)] / np.outer(spread[used], spread[used])
    found: dict = {"runs": runs}
    for at, (target, strength) in enumerate(ridge.items(), features + 1):
        y = rest[at, one] / runs
        y_spread = np.sqrt(max(rest[at, at] / runs - y * y, 0))
        coefficients = np.zeros(features)
        if y_spread > 1e-12 * max(abs(y), 1e-300) and len(used):
            shared = (rest[used, at] / runs - mean[used] * y) / (spread[used] * y_spread)
            damped = matrix + strength / y_spread * np.eye(len(used))
            coefficients[used] = np.linalg.lstsq(damped, shared, rcond=1e-14)[0] * y_spread / spread[used]
        intercept = y - mean @ coefficients
        found |= {f"intercept_{target}": intercept, f"coefficients_{target}": coefficients.tolist(), f"mean_{target}": y, f"mean_predicted_{target}": rest[:features, one] @ coefficients / runs + intercept}
    return found


def linear_coefficients(cells: DataFrame, models: dict[str, PipelineModel], leave: list[str]) -> DataFrame:
    """One row for each group of `leave`: the models of all other cells.

    Columns: leave, runs (weight of the other cells) and for each target
    intercept_, coefficients_, mean_ and mean_predicted_ (over the other cells).
    A group that holds all cells has no row.
    """
    prepared = _prepared(models, cells)
    targets = list(models)
    slots = F.concat("_x", F.array(F.lit(1.0), *[F.col(t).cast("double") for t in targets]))
    features = models[targets[0]].stages[-1].numFeatures
    ridge = {t: m.stages[-1].getRegParam() for t, m in models.items()}
    pairs = prepared.select(*leave, F.explode(_products(slots, F.col("weight"))).alias("_p")).select(*leave, "_p.*")
    sums = stage(pairs.groupBy(*leave, "i", "j").agg(F.sum("s").alias("s")), "sums")

    def square(table: pd.DataFrame) -> np.ndarray:
        out = np.zeros((features + 1 + len(targets),) * 2)
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        out[i, j] = out[j, i] = table["s"].to_numpy()
        return out

    total = square(sums.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    per_target = [T.StructField(f"{n}_{t}", kind) for t in targets for n, kind in (("intercept", T.DoubleType()), ("coefficients", T.ArrayType(T.DoubleType())), ("mean", T.DoubleType()), ("mean_predicted", T.DoubleType()))]
    out = T.StructType([*(cells.schema[c] for c in leave), T.StructField("runs", T.DoubleType()), *per_target])

    def solve(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        found = _system(total, square(table), features, ridge)
        return pd.DataFrame([dict(zip(leave, key, strict=True)) | found] if found else [], columns=out.names)

    return sums.groupBy(*leave).applyInPandas(solve, out)


def linear_predictions(cells: DataFrame, models: dict[str, PipelineModel], leave: list[str]) -> DataFrame:
    """leave, features and predicted targets of every cell, from the models of the cells outside its group."""
    solved = stage(linear_coefficients(cells, models, leave), "coefficients")
    scored = _prepared(models, cells).join(solved, leave)
    said = lambda t: F.aggregate(F.zip_with("_x", f"coefficients_{t}", lambda x, b: x * b), F.col(f"intercept_{t}"), lambda a, p: a + p)
    others = [c for c in leave if c not in fv.FEATURES]
    return scored.select(*others, *fv.FEATURES, *[F.round(said(t), 9).alias(f"predicted_{t}") for t in models])
