"""The registered model queries fit the library's settings, not smaller models."""

import os

import pytest

import __spark_entry__ as contract
from runledger.catalog.standins import clear_shared
from runledger.operators import regression

DATA = "/root/testdata/sf0.001"
QUERIES = ["j2_four_regressors", "j4_cross_validation", "k10_fitted_models", "j6_actual_and_predicted", "j7_feature_importances", "h6_ranked_importances", "j10_single_model", "b7_model_save_and_load"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_queries_fit_the_settings(spark, monkeypatch, name):
    """A fast model stands in for each; only what the query asks for counts."""
    asked, fit = [], regression.fit

    def recorded(cells, model_type, **overrides):
        asked.append((model_type, overrides))
        return fit(cells, "linear_regression")

    monkeypatch.setattr(regression, "fit", recorded)
    monkeypatch.setattr(regression, "feature_importances", lambda models, cells: spark.createDataFrame([], "target string, feature string, importance double"))
    clear_shared()
    try:
        contract.queries()[name](spark, DATA)
    finally:
        clear_shared()
    assert {m for m, _ in asked} in ({"decision_tree"}, set(regression.LABELS)) and all(not overrides for _, overrides in asked)
