"""Label and key columns. Every function takes and returns Columns (no UDFs)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as fv


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def key(col: Column | str) -> Column:
    """Case- and padding-insensitive join key."""
    return F.lower(F.trim(col))


def compact_region_key(col: Column | str) -> Column:
    return F.replace(key(col), F.lit(" "), F.lit(""))


def zone_key(col: Column | str) -> Column:
    return F.upper(F.trim(col))


def workload_label(col: Column | str) -> Column:
    """cpu, memory and io become cpu-heavy, memory-heavy and io-heavy."""
    text = key(col)
    return F.when(text.isin(fv.SHORT_WORKLOADS), F.concat(text, F.lit("-heavy"))).otherwise(text)


def region_name(col: Column) -> Column:
    return F.coalesce(literal_map(fv.REGION_NAMES)[key(col)], col)


def run_zone(region: Column | str) -> Column:
    return F.coalesce(literal_map(fv.RUN_ZONES)[key(region)], F.lit(""))


def inferred_vcpus(machine_type: Column, listed: Column | None = None) -> Column:
    """Listed count, else the digits of a D-family size name, else the dotted size suffix."""
    name = F.lower(machine_type)
    from_digits = F.nullif(F.regexp_extract(name, fv.AZURE_SIZE_PATTERN, 1), F.lit("")).try_cast("double")
    from_suffix = F.when(
        F.contains(name, F.lit(".")),
        literal_map(fv.SIZE_SUFFIX_VCPUS)[F.substring_index(name, ".", -1)],
    )
    options = [from_digits, from_suffix] if listed is None else [listed.cast("double"), from_digits, from_suffix]
    return F.coalesce(*options)


def goal(col: Column | str) -> Column:
    """Canonical goal name; an unknown goal fails the query."""
    text = F.replace(key(col), F.lit("-"), F.lit("_"))
    return F.coalesce(
        literal_map(fv.GOAL_ALIASES)[text],
        F.raise_error(F.concat(F.lit("unknown optimization goal: "), F.coalesce(text, F.lit("null")))).cast("string"),
    )


def pricing_model(col: Column | str) -> Column:
    text = key(col)
    return (
        F.when(text.isin(fv.ON_DEMAND_NAMES), F.lit("on-demand"))
        .when(text.isin(fv.SPOT_NAMES), F.lit("spot"))
        .otherwise(text)
    )


def tier_pricing_model(tier: Column) -> Column:
    """Pricing model a meter belongs to: spot if it names spot or low priority."""
    text = F.lower(tier)
    is_spot = F.contains(text, F.lit("spot")) | F.contains(text, F.lit("low priority"))
    return F.when(is_spot, F.lit("spot")).otherwise(F.lit("on-demand"))


def is_spot_meter(tier: Column, wanted: Column) -> Column:
    """Whether a meter matches the wanted pricing model; anything not spot counts as on demand."""
    wants_spot = pricing_model(wanted) == "spot"
    return (tier_pricing_model(tier) == "spot") == wants_spot


def reason(goal_col: Column, no_sla_match: Column) -> Column:
    prefix = F.when(no_sla_match, F.lit(fv.NO_SLA_PREFIX)).otherwise(F.lit(""))
    return F.concat(prefix, literal_map(fv.REASONS)[goal_col], F.lit("."))


def config_label(cloud: Column, region: Column, machine: Column, nodes: Column) -> Column:
    return F.format_string("%s %s %s x%d", cloud, region, machine, nodes.cast("int"))


def group_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def fold_of(group: Column, folds: int) -> Column:
    """Fold number 1..folds from the first 8 hex digits of the group's MD5."""
    return (F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("bigint") % folds + 1).cast("int")


def size_label(size_mb: Column) -> Column:
    return F.concat(size_mb.cast("bigint").cast("string"), F.lit("mb"))


def safe_name(col: Column) -> Column:
    return F.translate(col, "._-", "")


def short_workload(col: Column) -> Column:
    return F.replace(col, F.lit("-heavy"), F.lit(""))


def plan_labels(plan: DataFrame, root: str) -> DataFrame:
    """Dataset, script and output paths of every planned run."""
    label = size_label(F.col("dataset_size_mb"))
    short = short_workload(F.col("workload_type"))
    machine = safe_name(F.col("machine_type"))
    script = literal_map(fv.WORKLOAD_SCRIPTS)[F.col("workload_type")]
    tail = F.concat_ws("_", short, label, machine, F.col("nodes").cast("string"))
    return plan.select(
        "*",
        label.alias("size_label"),
        short.alias("short_workload"),
        machine.alias("safe_instance"),
        F.concat(F.lit(f"{root}/data/events_"), label, F.lit(".csv")).alias("dataset_uri"),
        F.concat(F.lit(f"{root}/scripts/"), script).alias("script_uri"),
        F.concat(F.lit(f"{root}/output/"), F.col("region"), F.lit("/"), tail).alias("output_uri"),
    )


def size_code(vm_size: Column) -> Column:
    """Standard_D4as_v4 becomes d4as_v4."""
    return F.lower(F.replace(vm_size, F.lit("Standard_"), F.lit("")))


def region_abbreviation(region: Column) -> Column:
    known = literal_map(fv.REGION_ABBREVIATIONS)[region]
    return F.coalesce(known, F.substring(F.replace(region, F.lit("-"), F.lit("")), 1, 4))


def joined_reason(*parts: Column) -> Column:
    """Non-empty parts joined by ' | ', at most 1500 characters."""
    filled = [F.nullif(p, F.lit("")) for p in parts]
    return F.substring(F.concat_ws(" | ", *filled), 1, fv.MAX_REASON_LENGTH)


def run_finished(life_cycle: Column) -> Column:
    return F.coalesce(life_cycle.isin(fv.FINISHED_STATES), F.lit(False))


def run_succeeded(life_cycle: Column, result: Column) -> Column:
    return F.coalesce((life_cycle == "TERMINATED") & (result == "SUCCESS"), F.lit(False))


def run_state_text(life_cycle: Column, result: Column) -> Column:
    joined = F.concat(F.coalesce(life_cycle, F.lit("")), F.lit("/"), F.coalesce(result, F.lit("")))
    return F.btrim(joined, F.lit("/"))


def pareto_label(on_front: Column) -> Column:
    return F.when(on_front, F.lit("Pareto optimal")).otherwise(F.lit("Dominated"))
