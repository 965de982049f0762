"""Emissions, Pareto fronts and trade-offs of measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import cleaning, enrich, pareto
from runledger.session import stage

REQUIRED = [
    "cloud", "region", "machine_type", "nodes", "workload_type", "dataset_size_mb", "runtime_minutes",
    "cost_usd", "carbon_intensity_mean",
]


def configurations(dataset: DataFrame, power: DataFrame | None, vcpus: DataFrame | None = None) -> DataFrame:
    """Mean cost, runtime, energy and emissions per scenario, configuration and zone."""
    runs = cleaning.complete_cases(dataset, REQUIRED).withColumn("nodes", F.col("nodes").cast("int"))
    runs = cleaning.with_missing_columns(
        runs, {"electricity_zone": "string", "renewable_percentage_mean": "double"}, {"electricity_zone": "unknown"}
    )
    return pareto.aggregate_configurations(pareto.with_emissions(enrich.attach_power(runs, power, vcpus)))


CONFIG_KEY = [*pareto.fv.SCENARIO, *pareto.fv.CONFIG, "electricity_zone"]


def carbon_analysis(dataset: DataFrame, power: DataFrame | None, vcpus: DataFrame | None = None) -> dict[str, DataFrame]:
    """carbon_per_run, pareto_front, tradeoff, by_region and the one-row summary.

    The configurations are written once; all five tables are built from them.
    """
    configs = stage(configurations(dataset, power, vcpus), "configurations")
    flagged = pareto.flag_pareto(configs, CONFIG_KEY)
    trade = pareto.tradeoff(configs)
    return {
        "carbon_per_run": configs,
        "pareto_front": flagged,
        "tradeoff": trade,
        "by_region": pareto.regional_summary(configs),
        "summary": pareto.front_summary(flagged, trade),
    }
