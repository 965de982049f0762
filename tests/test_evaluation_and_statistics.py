import numpy as np
import pandas as pd
import pytest

from runledger import fixed_values as fv
from runledger.functions.significance import signed_rank_p, t_quantile, t_two_sided
from runledger.operators import evaluation, statistics

# Published MAE of runtime by model and fold.
MAE = {
    "linear_regression": [0.612753, 0.595855, 0.576729, 0.535283, 0.551718],
    "decision_tree": [0.309825, 0.317657, 0.337199, 0.381084, 0.326271],
    "random_forest": [0.269293, 0.267443, 0.257825, 0.313697, 0.240582],
    "gradient_boosting": [0.277278, 0.30736, 0.289084, 0.302071, 0.248447],
}
# Published mean difference, interval, t, p, W, p and d of three of the pairs.
PUBLISHED = {
    ("decision_tree", "gradient_boosting"): (0.049559, 0.012834, 0.086285, 3.7467, 0.02, 0.0, 0.0625, 1.6756),
    ("gradient_boosting", "random_forest"): (0.01508, -0.010474, 0.040634, 1.6385, 0.1767, 3.0, 0.3125, 0.7327),
    ("linear_regression", "random_forest"): (0.3047, 0.245101, 0.364299, 14.1946, 0.0001, 0.0, 0.0625, 6.348),
}


def test_paired_tests_reproduce_the_published_table(spark):
    rows = [(m, f + 1, "runtime_minutes", v) for m, values in MAE.items() for f, v in enumerate(values)]
    rows.append(("linear_regression", 6, "runtime_minutes", 0.5))  # an incomplete fold is left out
    tests = statistics.paired_tests(spark.createDataFrame(rows, "model string, fold int, target string, mae double")).collect()
    got = {(r.model_a, r.model_b): r for r in tests}
    assert len(got) == 6 and sum(r.significant_at_0_05 for r in tests) == 5
    for pair, (mean, low, high, t, p, w, wp, d) in PUBLISHED.items():
        r = got[pair]
        assert (r.folds, r.wilcoxon_statistic, r.wilcoxon_p_value) == (5, w, wp)
        assert [r.mean_difference, r.ci95_lower, r.ci95_upper] == pytest.approx([mean, low, high], abs=2e-6)
        assert [r.paired_t_statistic, r.paired_t_p_value, r.cohens_d] == pytest.approx([t, p, d], abs=0.01)


def test_equal_models_have_no_difference(spark):
    rows = [(m, f, "cost_usd", 0.1 * f) for m in "ab" for f in (1, 2, 3)]
    [r] = statistics.paired_tests(spark.createDataFrame(rows, "model string, fold int, target string, mae double")).collect()
    assert (r.wilcoxon_statistic, r.wilcoxon_p_value, r.cohens_d, r.significant_at_0_05, r.ci_excludes_zero) == (None, 1.0, 0.0, False, False)


def test_distributions():
    assert [round(t_quantile(0.95, df), 3) for df in (1, 4, 10, 30)] == [12.706, 2.776, 2.228, 2.042]
    assert t_two_sided(2.0, 5000) == pytest.approx(0.045554, abs=2e-5)
    assert t_two_sided(2.0, 1999) == pytest.approx(t_two_sided(2.0, 2001), abs=1e-5)
    assert signed_rank_p(3, 5, False, 0.0) == 0.3125 and signed_rank_p(0, 5, False, 0.0) == 0.0625
    assert signed_rank_p(100.0, 60, False, 0.0) < 1e-6


def sample_runs(seed=3, rows=700):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "workload_type": rng.choice(["cpu-heavy", "io-heavy"], rows), "dataset_size_mb": rng.choice([10.0, 100.0, 500.0], rows),
        "cloud": rng.choice(["aws", "azure"], rows), "region": "r", "machine_type": rng.choice(["m1", "m2", "m3"], rows),
        "nodes": rng.choice([2, 4], rows), "electricity_zone": "z",
        "runtime_minutes": rng.integers(1, 60, rows) / 8.0, "cost_usd": rng.integers(1, 90, rows) / 64.0,
    })
    frame["carbon_intensity_mean"] = np.where(frame.cloud == "aws", 400.0, 300.0)
    frame["renewable_percentage_mean"] = 20.0
    # one configuration is measured in a single scenario, so nothing else is known of it
    frame.loc[0, ["machine_type", "workload_type", "dataset_size_mb"]] = ["rare", "cpu-heavy", 10.0]
    return frame


def brute_quality(frame):
    """Straightforward per-scenario loop over the same protocol (all but the random method)."""
    keys, config = fv.SCENARIO, fv.CONFIG
    out = {}
    for scenario, rows in frame.groupby(keys):
        train = frame[~((frame.workload_type == scenario[0]) & (frame.dataset_size_mb == scenario[1]))]
        truth = rows.groupby(config, as_index=False).agg(rt=("runtime_minutes", "mean"), cost=("cost_usd", "mean"))
        hist = truth.merge(train.groupby(config, as_index=False).agg(h_rt=("runtime_minutes", "mean"), h_cost=("cost_usd", "mean")), "left", on=config)
        hist["h_rt"] = hist.h_rt.fillna(train.runtime_minutes.mean())
        hist["h_cost"] = hist.h_cost.fillna(train.cost_usd.mean())
        near = []
        for row in truth.itertuples():
            same = train[(train.workload_type == scenario[0])]
            own = same[(same[config] == list(row[1:5])).all(axis=1)]
            pool = own if len(own) else same
            pool = pool.assign(d=(pool.dataset_size_mb - scenario[1]).abs()).sort_values(["d", "dataset_size_mb", "runtime_minutes", "cost_usd"])
            near.append((pool.runtime_minutes.iloc[0], pool.cost_usd.iloc[0]))
        hist["n_rt"], hist["n_cost"] = zip(*near)
        for level, q in fv.SLA_LEVELS.items():
            sla = truth.rt.quantile(q)
            ok = truth[truth.rt <= sla].sort_values(["cost", *config])
            best = tuple(ok.iloc[0][config])
            for method in ("historical_mean", "nearest_size", "largest_cluster"):
                rt, cost = ("n_rt", "n_cost") if method == "nearest_size" else ("h_rt", "h_cost")
                pool = hist[hist[rt] <= sla]
                none = pool.empty
                pool = hist.sort_values(rt, kind="mergesort") if none else pool
                if method == "largest_cluster":
                    pool = pool.sort_values(["nodes", cost], ascending=[False, True], kind="mergesort")
                else:
                    pool = pool.sort_values([cost, rt], kind="mergesort")
                order = [tuple(r) for r in pool[config].itertuples(index=False)]
                chosen = pool.iloc[0]
                out[(*scenario, level, method)] = (
                    order[0], int(order[0] == best), int(best in order[:3]), round((chosen.cost - ok.cost.min()) / ok.cost.min() * 100, 4),
                    int(chosen.rt > sla and not none), int(none),
                )
    return out


def test_quality_detail_equals_the_scenario_loop(spark):
    frame = sample_runs()
    detail = evaluation.quality_detail(spark.createDataFrame(frame).repartition(5)).filter("method <> 'random'").collect()
    expected = brute_quality(frame)
    assert len(detail) == len(expected)
    for r in detail:
        got = (
            (r.chosen_cloud, r.chosen_region, r.chosen_machine_type, r.chosen_nodes), r.top1_correct, r.top3_correct,
            pytest.approx(r.cost_regret_pct, abs=2e-4), r.sla_violation, r.no_feasible_prediction,
        )
        assert expected[(r.workload_type, r.dataset_size_mb, r.sla_level, r.method)] == got


def test_quality_does_not_depend_on_partitioning(spark):
    runs = spark.createDataFrame(sample_runs(5, 300))
    one = sorted(evaluation.quality_detail(runs.coalesce(1)).collect())
    assert one == sorted(evaluation.quality_detail(runs.repartition(7, "nodes")).collect())
    assert {r.method for r in one} == set(fv.BASELINE_METHODS)


def test_summary_order_and_negative_regret(spark):
    columns = "method string, sla_level string, top1_correct int, top3_correct int, cost_regret_pct double, runtime_regret_pct double, carbon_regret_pct double, sla_violation int, no_feasible_prediction int"
    rows = [(m, level, 1, 1, r, 0.0, 0.0, 0, 0) for m in ("random", "nearest_size") for level in ("loose", "tight") for r in (-4.0, 1.0, 9.0)]
    summary = evaluation.quality_summary(spark.createDataFrame(rows, columns)).collect()
    assert [(r.method, r.sla_level) for r in summary] == [("nearest_size", "tight"), ("nearest_size", "loose"), ("random", "tight"), ("random", "loose")]
    assert (summary[0].median_cost_regret_pct, summary[0].mean_cost_regret_pct, summary[0].max_cost_regret_pct) == (1.0, 2.0, 9.0)


def test_repeatability(spark):
    frame = sample_runs(1, 200)
    got = {tuple(r[c] for c in [*fv.SCENARIO, *fv.CONFIG]): r for r in statistics.repeatability(spark.createDataFrame(frame)).collect()}
    groups = [(k, g.runtime_minutes) for k, g in frame.groupby([*fv.SCENARIO, *fv.CONFIG]) if len(g) > 1]
    assert len(got) == len(groups)
    for key, x in groups:
        margin = t_quantile(0.95, len(x) - 1) * x.std() / np.sqrt(len(x))
        r = got[key]
        assert [r.mean_runtime_minutes, r.std_runtime_minutes, r.ci95_lower, r.ci95_upper] == pytest.approx([x.mean(), x.std(), x.mean() - margin, x.mean() + margin], abs=1e-4)


def test_metrics(spark):
    rows = [("m", 1.0, 1.5), ("m", 2.0, 2.0), ("m", 4.0, 3.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0)]
    got = {r.model: r for r in statistics.regression_metrics(spark.createDataFrame(rows, "model string, actual double, predicted double"), ["model"]).collect()}
    actual, predicted = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    assert got["m"].mae == pytest.approx(0.5) and got["m"].rmse == pytest.approx(np.sqrt(1.25 / 3))
    assert got["m"].r2 == pytest.approx(1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum())
    assert got["flat"].r2 == 1.0
