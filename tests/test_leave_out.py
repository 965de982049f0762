"""Linear models solved from sums equal those fitted to the remaining cells."""

import os

import pytest
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.catalog.standins import Inputs, clear_shared
from runledger.operators import leave_out, regression

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    clear_shared()
    found = regression.training_cells(regression.model_rows(Inputs(spark, DATA)("dataset")))
    yield found
    clear_shared()


def by_features(df):
    return {tuple(r[c] for c in fv.FEATURES): [r[f"predicted_{t}"] for t in fv.TARGETS] for r in df.collect()}


def test_predictions_of_left_out_scenarios_equal_fits(spark, cells):
    whole = regression.fit(cells, "linear_regression")
    assert leave_out.solvable(whole)
    found = by_features(leave_out.linear_predictions(cells, whole, fv.SCENARIO))
    assert len(found) == cells.count()
    for scenario in cells.select(*fv.SCENARIO).distinct().orderBy(*fv.SCENARIO).limit(3).collect():
        inside = (F.col("workload_type") == scenario[0]) & (F.col("dataset_size_mb") == scenario[1])
        fitted = by_features(regression.unclamped(regression.pipelines(cells.filter(~inside), "linear_regression"), cells.filter(inside).select(*fv.FEATURES)))
        assert fitted
        for features, values in fitted.items():
            assert found[features] == pytest.approx(values, rel=1e-4, abs=1e-5)


def test_a_label_that_only_the_left_out_group_has(spark, cells):
    """Leaving out a whole workload: its label is unseen by the fit, and so it is here."""
    whole = regression.fit(cells, "linear_regression")
    found = by_features(leave_out.linear_predictions(cells, whole, ["workload_type"]))
    first = cells.select("workload_type").distinct().orderBy("workload_type").first()[0]
    inside = F.col("workload_type") == first
    fitted = by_features(regression.unclamped(regression.pipelines(cells.filter(~inside), "linear_regression"), cells.filter(inside).select(*fv.FEATURES)))
    for features, values in fitted.items():
        assert found[features] == pytest.approx(values, rel=1e-4, abs=1e-5)


def test_a_group_of_all_cells_has_no_model(spark, cells):
    whole = regression.fit(cells, "linear_regression")
    assert leave_out.linear_coefficients(cells.withColumn("fold", F.lit(1)), whole, ["fold"]).collect() == []


def test_constant_targets_and_repeated_cells(spark, cells):
    """A constant target is predicted as itself; a cell given twice counts like one of twice the weight."""
    constant = cells.withColumn("cost_usd", F.lit(3.0))
    whole = regression.fit(constant, "linear_regression")
    rows = leave_out.linear_predictions(constant, whole, fv.SCENARIO)
    assert rows.filter(F.abs(F.col("predicted_cost_usd") - 3) > 1e-6).isEmpty()
    twice = by_features(leave_out.linear_predictions(constant.unionByName(constant), whole, fv.SCENARIO))
    double = by_features(leave_out.linear_predictions(constant.withColumn("weight", 2 * F.col("weight")), whole, fv.SCENARIO))
    assert twice.keys() == double.keys()
    assert all(twice[k] == pytest.approx(double[k], abs=1e-6) for k in twice)


def test_other_models_are_not_solved_from_sums(spark, cells):
    assert not leave_out.solvable(regression.fit(cells, "linear_regression", elasticNetParam=0.5, solver="l-bfgs"))
    assert not leave_out.solvable(regression.fit(cells, "decision_tree", maxDepth=2))


def test_evaluation_and_folds_take_the_sums(spark, cells, monkeypatch):
    """One fit in all, however many scenarios and folds there are."""
    dataset = Inputs(spark, DATA)("dataset")
    fits, fit = [], regression.fit
    monkeypatch.setattr(regression, "fit", lambda *a, **o: fits.append(a[1]) or fit(*a, **o))
    left_out = regression.left_out_predictions(dataset, "linear_regression", "linear")
    scenarios = cells.select(*fv.SCENARIO).distinct().count()
    assert left_out.select(*fv.SCENARIO).distinct().count() == scenarios > 1 and fits == ["linear_regression"]
    assert left_out.filter("linear_runtime < 0.01 OR linear_cost < 0").isEmpty()
    folds = regression.cross_validate(dataset, ["linear_regression"]).collect()
    assert fits == ["linear_regression"] * 2 and len({r["fold"] for r in folds}) > 1
