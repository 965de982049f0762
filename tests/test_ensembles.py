"""Trees against a plain recursive tree, and forests fitted for real."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from runledger import fixed_values as fv
from runledger.catalog.standins import clear_shared
from runledger.operators import ensembles, regression

DATA = "/root/testdata/sf0.001"


def plain(features, weight, target, rows, depth):
    """{row: what the tree says}, by trying every split of every node."""
    train = [i for i in rows if weight[i] > 0]
    w, s = sum(weight[i] for i in train), sum(weight[i] * target[i] for i in train)
    says = dict.fromkeys(rows, s / w)
    best, split = 1e-11 * sum(weight[i] * target[i] ** 2 for i in train), None
    for codes, values in features if depth else []:
        seen = sorted({int(codes[i]) for i in train})
        if values is None:
            splits = [lambda i, c=codes, k=k: c[i] == k for k in seen]
        else:
            splits = [lambda i, c=codes, v=values, x=(values[a] + values[b]) / 2: v[c[i]] <= x for a, b in zip(seen, seen[1:], strict=False)]
        for goes_left in splits:
            left = [i for i in train if goes_left(i)]
            lw, ls = sum(weight[i] for i in left), sum(weight[i] * target[i] for i in left)
            if 0 < lw < w and (gain := ls**2 / lw + (s - ls) ** 2 / (w - lw) - s**2 / w) > best * (1 + 1e-12):
                best, split = gain, goes_left
    for side in (True, False) if split else ():
        says |= plain(features, weight, target, [i for i in rows if bool(split(i)) is side], depth - 1)
    return says


@pytest.mark.parametrize("entries", [40, 1 << 21])
def test_trees_match_a_plain_tree(monkeypatch, entries):
    monkeypatch.setattr(ensembles, "ENTRIES", entries)
    draw = np.random.default_rng(1)
    for _ in range(20):
        n = 50
        numbers = [np.unique(x, return_inverse=True) for x in (draw.integers(0, 9, n) * 1.5, draw.normal(size=n))]
        features = [(draw.integers(0, 4, n), None), (draw.integers(0, 3, n), None), *((codes, values) for values, codes in numbers)]
        weight, target = draw.integers(0, 4, n).astype(float), draw.normal(size=n)
        for depth in (1, 2, 30):
            got = ensembles.grow(features, np.arange(n), np.zeros(n, int), weight, target, depth)
            expected = plain(features, weight, target, list(range(n)), depth)
            # Where two rows are left, every feature that tells them apart is as good; a row of weight 0 may go either way.
            compared = np.flatnonzero(weight > 0) if depth == 30 else range(n)
            assert all(abs(got[i] - expected[i]) < 1e-9 for i in compared)


def test_trees_don_t_mix():
    draw = np.random.default_rng(2)
    features = [(draw.integers(0, 5, 40), None), (draw.integers(0, 7, 40), np.arange(7.0))]
    target, weights = draw.normal(size=40), draw.integers(1, 4, (3, 40)).astype(float)
    together = ensembles.grow(features, np.tile(np.arange(40), 3), np.repeat([4, 9, 11], 40), weights.ravel(), np.tile(target, 3), 4).reshape(3, 40)
    for weight, says in zip(weights, together, strict=True):
        assert np.allclose(says, ensembles.grow(features, np.arange(40), np.zeros(40, int), weight, target, 4))


def test_many_numbers_are_binned():
    column = np.arange(1000.0)
    codes, values = ensembles._codes(column, np.ones(1000, bool), True, 128)
    assert len(values) == 128 and (np.diff(codes) >= 0).all() and np.bincount(codes).max() <= 9


@pytest.fixture(scope="module")
def cells(spark):
    draw = np.random.default_rng(3)
    rows = [(f"c{i % 2}", f"r{i % 5}", "z", float(10 * (i % 7)), f"w{i % 3}", f"m{i % 4}", int(1 + i % 6), 100.0 + i % 5, 20.0, float(1 + i % 4), 5.0 * (i % 7) + i % 3, float(draw.normal())) for i in range(240)]
    names = dict(zip(["cloud", "region", "electricity_zone", "dataset_size_mb", "workload_type", "machine_type", "nodes", "carbon_intensity_mean", "renewable_percentage_mean", "weight", *fv.TARGETS], range(12), strict=True))
    return spark.createDataFrame([tuple(r[names[c]] for c in names) for r in rows], list(names)).dropDuplicates(fv.FEATURES)


@pytest.mark.parametrize(("model_type", "options"), [("random_forest", {"numTrees": 12}), ("gradient_boosting", {"maxIter": 40})])
def test_ensembles_are_fitted(spark, cells, monkeypatch, model_type, options):
    models = regression.fit(cells, model_type, **options)
    assert isinstance(models, regression.Ensembles)
    features = cells.select("weight", *fv.FEATURES)

    def found(m):
        return {tuple(r[c] for c in fv.FEATURES): r for r in regression.unclamped(m, features).join(cells.select(*fv.FEATURES, *fv.TARGETS), fv.FEATURES).collect()}

    rows = found(models)
    assert len(rows) == cells.count()
    errors = [r["predicted_runtime_minutes"] - r["runtime_minutes"] for r in rows.values()]
    spread = np.std([r["runtime_minutes"] for r in rows.values()])
    assert np.std(errors) < 0.3 * spread
    # The same from a shuffled table whose rows are scored in several parts.
    monkeypatch.setattr(ensembles, "GROUP_CELLS", 90)
    again = regression.Ensembles(cells.orderBy(F.desc("cost_usd")).repartition(7), model_type, options)
    for key, row in found(again).items():
        assert row["predicted_cost_usd"] == pytest.approx(rows[key]["predicted_cost_usd"]) and row["predicted_runtime_minutes"] == pytest.approx(rows[key]["predicted_runtime_minutes"])
    # More cells than a group holds are Spark ML's.
    assert not isinstance(regression.fit(cells, model_type, **{**options, "maxDepth": 2, **({"numTrees": 2} if model_type == "random_forest" else {"maxIter": 2})}), regression.Ensembles)


def test_saved_ensembles_are_pipelines(spark, cells, tmp_path):
    models = regression.fit(cells, "random_forest", numTrees=3, maxDepth=4)
    regression.save(models, str(tmp_path / "m"))
    assert regression.predict(regression.load(str(tmp_path / "m")), cells.select(*fv.FEATURES)).count() == cells.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_forest_at_the_library_s_settings(spark):
    """The registered hold-out comparison, with 250 trees to depth 30 and 100 rounds."""
    clear_shared()
    rows = contract.queries()["j6_tested_rows"](spark, DATA).collect()
    clear_shared()
    assert len(rows) == 4 and len({r["rows"] for r in rows}) == 1
