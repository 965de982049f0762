"""Composite reports: data quality, exploration, recommendation quality, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runledger import fixed_values as fv
from runledger.operators import cleaning, evaluation, profile, statistics
from runledger.session import stage


def cleaned_dataset(runs: DataFrame, **lists: list[str]) -> dict[str, DataFrame]:
    """Cleaned runs with null counts, rejects per rule, report and profile."""
    cleaned = stage(cleaning.cleaned_runs(runs, **lists), "cleaned")
    return {
        "cleaned": cleaned,
        "null_counts": cleaning.null_counts(runs),
        "report": cleaning.cleaning_report(runs, **lists),
        "profile": profile.numeric_profile(cleaned, ["dataset_size_mb", "nodes", "runtime_minutes", "cost_usd"]),
    }


def exploration(runs: DataFrame) -> dict[str, DataFrame]:
    runs = cleaning.require_columns(runs, profile.EDA_REQUIRED)
    return {
        "summary": profile.dataset_summary(runs),
        "numeric_profile": profile.numeric_profile(runs, ["dataset_size_mb", "nodes", *fv.TARGETS]),
        "text_profile": profile.text_profile(runs, ["workload_type", "machine_type"]),
        "grouped_summary": profile.grouped_summary(runs),
        "mean_cost": profile.mean_cost_by_workload(runs),
        "runtime_box": profile.runtime_box(runs),
        "runtime_by_size": profile.runtime_by_size(runs),
        "scatter": profile.scatter_rows(runs),
    }


def recommendation_quality(dataset: DataFrame, models: dict[str, DataFrame] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    runs = cleaning.complete_cases(dataset, [*fv.FEATURES, *fv.TARGETS])
    detail = stage(evaluation.quality_detail(runs, models, seed), "quality")
    return {
        "detail": detail,
        "summary": evaluation.quality_summary(detail, list(models or {})),
        "search_space": evaluation.search_space(evaluation.ground_truth(runs)),
        "skipped": evaluation.skipped_scenarios(evaluation.cells(runs)),
    }


def statistical_report(per_fold: DataFrame, runs: DataFrame, metric: str = "mae") -> dict[str, DataFrame]:
    per_fold = stage(per_fold, "per-fold")
    tests = stage(statistics.paired_tests(per_fold, metric), "tests")
    repeats = stage(statistics.repeatability(runs), "repeats")
    return {
        "per_fold": per_fold,
        "fold_summary": statistics.fold_summary(per_fold),
        "tests": tests,
        "test_summary": statistics.significance_summary(tests),
        "repeatability": repeats,
        "repeatability_summary": statistics.repeatability_summary(repeats),
    }
