"""J8 and J9 are registered for all four models, each with its own settings."""

import os

import pytest

import __spark_entry__ as contract
from runledger.catalog.standins import clear_shared
from runledger.operators import regression

DATA = "/root/testdata/sf0.001"
J8 = {"j8_model_recommendations": "linear_regression", "j8_tree_recommendations": "decision_tree", "j8_forest_recommendations": "random_forest", "j8_boosting_recommendations": "gradient_boosting"}
J9 = {"j9_model_quality": "linear_regression", "j9_tree_quality": "decision_tree", "j9_forest_quality": "random_forest", "j9_boosting_quality": "gradient_boosting"}


class Asked(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "model_type"), [*J8.items(), *J9.items()])
def test_every_model_is_registered(spark, monkeypatch, name, model_type):
    def asked(cells, model_type, **overrides):
        raise Asked(model_type, overrides)

    monkeypatch.setattr(regression, "fit", asked)
    clear_shared()
    with pytest.raises(Asked) as found:
        contract.queries()[name](spark, DATA)
    clear_shared()
    assert found.value.args == (model_type, {})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tree_recommendations(spark):
    clear_shared()
    rows = contract.queries()["j8_tree_recommendations"](spark, DATA).collect()
    clear_shared()
    assert rows
