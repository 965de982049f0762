"""The merged modelling dataset: runs of all clouds with grid features and emissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import labels, measures
from runledger.operators import cleaning, enrich
from runledger.session import stage

RUN_COLUMNS = {
    "cloud": "string", "region": "string", "run_date": "date", "dataset_size_mb": "double", "workload_type": "string",
    "machine_type": "string", "nodes": "int", "runtime_minutes": "double", "cost_usd": "double",
    "cpu_avg_pct": "double", "memory_avg_pct": "double",
}
VM_NAMES = {
    "VM_Size": "machine_type", "Dataset_Size_MB": "dataset_size_mb", "Runtime_Minutes": "runtime_minutes",
    "Cost_USD": "cost_usd", "Nodes": "nodes", "Region": "region", "Workload": "workload_type", "CPU_Avg_Pct": "cpu_avg_pct",
}
DATABRICKS_NAMES = {"instance_type": "machine_type", "cloud_provider": "cloud"}


def _shaped(df: DataFrame) -> DataFrame:
    df = cleaning.with_missing_columns(df, RUN_COLUMNS)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in RUN_COLUMNS.items()])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Legacy column names replaced; a new name already present is left alone."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and (new not in df.columns or new.lower() == old.lower())})


def aws_runs(df: DataFrame) -> DataFrame:
    df = cleaning.require_columns(renamed(df, {"instance_type": "machine_type"}), ["region"])
    return _shaped(df.withColumns({
        "cloud": F.lit("AWS"),
        "region": F.trim("region"),
        "workload_type": labels.workload_label("workload_type"),
        "run_date": F.lit(None).cast("date"),
    }))


def azure_runs(df: DataFrame) -> DataFrame:
    """Successful VM runs with region display names and the run's UTC date."""
    df = cleaning.successful(df, "Exit_Status")
    df = renamed(df, VM_NAMES)
    return _shaped(df.withColumns({
        "cloud": F.lit("Azure"),
        "region": labels.region_name(F.col("region")),
        "run_date": cleaning.utc_date(F.col("Timestamp").cast("string")),
        "workload_type": labels.workload_label("workload_type"),
    }))


def databricks_runs(df: DataFrame) -> DataFrame:
    return _shaped(renamed(df, DATABRICKS_NAMES).withColumns({
        "cloud": F.lit("Azure"),
        "region": labels.region_name(F.col("region")),
        "workload_type": labels.workload_label("workload_type"),
        "run_date": F.lit(None).cast("date"),
    }))


def all_runs(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def merged_dataset(runs: DataFrame, daily: DataFrame, basis: str = "regional_mean") -> DataFrame:
    """Runs with carbon features on the given basis and the emissions proxy."""
    keyed = enrich.with_join_keys(runs)
    merged = enrich.attach_carbon(keyed, daily, enrich.regional_features(daily), basis)
    return merged.drop(*enrich.KEYS).withColumn(
        "estimated_emissions_gco2eq",
        measures.emissions_proxy(F.col("runtime_minutes"), F.col("carbon_intensity_mean")),
    )


def build_dataset(aws: DataFrame, vm_results: DataFrame, carbon: DataFrame, renewable: DataFrame, databricks: DataFrame | None = None, basis: str = "regional_mean") -> dict[str, DataFrame]:
    """From the raw tables of each cloud and the raw daily readings to the model dataset and its audits.

    dataset: the runs of all clouds with carbon features and emissions.
    coarse_zones: its rows in zones that are too coarse, with the zone to use.
    many_zones: regions whose readings come from several zones, so that each of
    their undated runs is in the dataset once a zone.
    """
    daily = stage(enrich.daily_readings(carbon, renewable), "daily")
    tables = [aws_runs(aws), azure_runs(vm_results), *([databricks_runs(databricks)] if databricks is not None else [])]
    dataset = stage(merged_dataset(all_runs(*tables), daily, basis), "model-dataset")
    return {"dataset": dataset, "coarse_zones": cleaning.coarse_zone_audit(dataset), "many_zones": enrich.many_zone_regions(enrich.regional_features(daily))}


def zone_keyed_dataset(runs: DataFrame, carbon: DataFrame, renewable: DataFrame) -> DataFrame:
    """The older merge: regional means joined on normalised cloud, region and zone."""
    keys = ["cloud", "region", "electricity_zone"]

    def normal(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "cloud": labels.key("cloud"),
            "region": labels.compact_region_key("region"),
            "electricity_zone": labels.zone_key("electricity_zone"),
        })

    left = normal(carbon.select("Date", "Cloud", "Region", "Electricity_Zone", F.col("Carbon_Intensity_gCO2eq_per_kWh").alias("carbon_intensity")))
    right = normal(renewable.select("Date", "Cloud", "Region", "Electricity_Zone", F.col("Renewable_Percentage").alias("renewable_percentage")))
    daily = left.join(right, ["Date", *keys])
    means = enrich.stage(enrich.regional_means(daily, keys))
    return normal(runs).join(means, keys, "left")
