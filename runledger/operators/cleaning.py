"""Cleaning and quality checks of run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import fixed_values as fv
from runledger.functions import labels

REQUIRED = ["dataset_size_mb", "workload_type", "machine_type", "nodes", "runtime_minutes", "cost_usd", "source"]
TEXT = ["workload_type", "machine_type", "source"]


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def complete_cases(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows without null or NaN in the subset."""
    return require_columns(df, subset).dropna(subset=subset)


def standard_text(df: DataFrame, columns: list[str] = TEXT) -> DataFrame:
    return df.withColumns({c: labels.key(F.col(c)) for c in columns})


def typed_numbers(df: DataFrame) -> DataFrame:
    """Doubles and whole node counts; text that is no number becomes null."""
    casts = {"dataset_size_mb": "double", "nodes": "int", "runtime_minutes": "double", "cost_usd": "double"}

    def to_type(name: str, kind: str) -> Column:
        col = F.col(name)
        if kind == "int" and isinstance(df.schema[name].dataType, T.StringType):
            col = col.try_cast("double")
        return col.try_cast(kind)

    return df.withColumns({name: to_type(name, kind) for name, kind in casts.items()})


def validity_rules(machines: list[str] | None = None, workloads: list[str] | None = None) -> dict[str, Column]:
    """Named rules a valid run meets; a null input fails its rule."""
    machines = fv.VALID_MACHINES if machines is None else machines
    workloads = fv.VALID_WORKLOADS if workloads is None else workloads
    rules = {
        "size": F.col("dataset_size_mb") > 0,
        "nodes": F.col("nodes") > 0,
        "runtime_low": F.col("runtime_minutes") > 0,
        "runtime_high": F.col("runtime_minutes") < fv.MAX_RUNTIME_MINUTES,
        "cost": F.col("cost_usd") >= 0,
        "workload": F.col("workload_type").isin(workloads),
        "machine": F.col("machine_type").isin(machines),
        "source": F.col("source") != "",
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def valid_runs(df: DataFrame, **lists: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, validity_rules(**lists).values()))


def rejects_by_rule(df: DataFrame, **lists: list[str]) -> DataFrame:
    """Rows failing each rule, in one pass over the data."""
    rules = validity_rules(**lists)
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "rejected")


def successful(df: DataFrame, status: str = "exit_status") -> DataFrame:
    """Successful rows where the table has a status column, else all rows."""
    return df.filter(F.col(status) == "SUCCESS") if status in df.columns else df


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row per group of identical rows (partial aggregation collapses copies before the shuffle)."""
    return df.dropDuplicates()


def newest_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by the given order columns.

    An aggregate, not a window: a key holding a large share of the copies is
    reduced inside each map task before anything is shuffled. Rows that agree
    on every order column are told apart by their remaining values.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*").select(*df.columns)


def cleaned_runs(df: DataFrame, unify_workloads: bool = False, **lists: list[str]) -> DataFrame:
    """Distinct, complete, standardised and valid runs.

    Copies are removed before text is standardised, so rows differing only in
    case or padding survive; unify_workloads also maps cpu_heavy to cpu-heavy
    and removes the copies that remain after standardising.
    """
    runs = typed_numbers(standard_text(complete_cases(distinct_rows(df), REQUIRED)))
    runs = valid_runs(runs, **lists)
    if unify_workloads:
        runs = runs.withColumn("workload_type", F.translate("workload_type", "_", "-")).dropDuplicates()
    return runs


def cleaning_report(df: DataFrame, **lists: list[str]) -> DataFrame:
    """Original, duplicate, null-dropped and final counts from one aggregation over row groups."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    flagged = typed_numbers(standard_text(copies.withColumn("_complete", complete)))
    valid = reduce(lambda a, b: a & b, validity_rules(**lists).values())
    return flagged.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("original_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(~F.col("_complete")).alias("null_rows_removed"),
        F.count_if(F.col("_complete") & valid).alias("final_rows"),
    )


def coarse_zone_audit(df: DataFrame, zone: str = "electricity_zone") -> DataFrame:
    """Rows per zone that is coarser than its deployment region, with the zone to use instead."""
    return (
        df.filter(F.col(zone).isin(list(fv.COARSE_ZONES)))
        .groupBy(zone)
        .agg(F.count(F.lit(1)).alias("affected_rows"))
        .withColumn("use_instead", labels.literal_map(fv.COARSE_ZONES)[F.col(zone)])
    )


def coarse_region_mappings(mapping: DataFrame) -> DataFrame:
    """(cloud, region, zone) rows mapped to a zone that is too coarse."""
    return mapping.filter(F.col("electricity_zone").isin(list(fv.COARSE_ZONES)))


def zones_in_order(mapping: DataFrame, position: str = "position") -> DataFrame:
    """Distinct zones in the order of first declaration."""
    return mapping.groupBy("electricity_zone").agg(F.min(position).alias(position)).orderBy(position)


def unknown_workloads(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests naming a workload no run has."""
    return requests.join(runs.select("workload_type").distinct(), "workload_type", "left_anti")


def with_missing_columns(df: DataFrame, columns: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Add absent columns as typed nulls or defaults."""
    defaults = defaults or {}
    absent = {n: F.lit(defaults.get(n)).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def utc_date(col: Column | str) -> Column:
    """Date of a timestamp text, null when it cannot be parsed (session time zone UTC)."""
    return F.to_date(F.try_to_timestamp(col))
