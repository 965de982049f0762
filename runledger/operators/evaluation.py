"""Recommendation quality against measured runs, leaving one scenario out at a time.

The raw runs are read once, into per-cell sums. Every step after that is an
aggregation that combines inside the map tasks, so a scenario or configuration
holding a large share of the cells needs no task of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import measures
from runledger.operators.quantiles import exact_quantiles
from runledger.session import stage

CELL = [*fv.SCENARIO, *fv.CONFIG]
ZONE = "electricity_zone"
_DIGITS = 9


def ground_truth(runs: DataFrame) -> DataFrame:
    """Measured means per scenario, configuration and zone."""
    complete = runs.dropna(subset=[*CELL, ZONE])
    truth = complete.groupBy(*CELL, ZONE).agg(
        measures.mean_of("runtime_minutes").alias("measured_runtime_minutes"),
        measures.mean_of("cost_usd").alias("measured_cost_usd"),
        measures.mean_of("carbon_intensity_mean").alias("carbon_intensity_mean"),
        measures.mean_of("renewable_percentage_mean").alias("renewable_percentage_mean"),
        F.count(F.lit(1)).alias("runs"),
    )
    return truth.withColumn("measured_emissions", _proxy())


def _proxy() -> Column:
    return F.round(measures.emissions_proxy(F.col("measured_runtime_minutes"), F.col("carbon_intensity_mean")), _DIGITS)


def cells(runs: DataFrame) -> DataFrame:
    """Sums, counts and the fastest run per scenario, configuration and zone.

    Spark sorts all rows for the least of a struct but keeps that of a number in
    a hash table, so the least runtime comes first, then the least cost among
    the cell's runs that have it.
    """
    complete = runs.dropna(subset=[*CELL, ZONE, "carbon_intensity_mean", "renewable_percentage_mean", *fv.TARGETS])
    sums = complete.groupBy(*CELL, ZONE).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("runtime_minutes").alias("runtime_sum"),
        F.sum("cost_usd").alias("cost_sum"),
        measures.mean_of("runtime_minutes").alias("measured_runtime_minutes"),
        measures.mean_of("cost_usd").alias("measured_cost_usd"),
        measures.mean_of("carbon_intensity_mean").alias("carbon_intensity_mean"),
        measures.mean_of("renewable_percentage_mean").alias("renewable_percentage_mean"),
        F.min("runtime_minutes").alias("_least"),
    )
    sums = stage(sums, "cell-sums")
    least = sums.select(*CELL, ZONE, "_least")
    fastest = complete.join(least, [*CELL, ZONE]).filter(F.col("runtime_minutes") == F.col("_least")).groupBy(*CELL, ZONE).agg(F.min("cost_usd").alias("_cheapest"))
    run = F.struct(F.col("_least").alias("runtime_minutes"), F.col("_cheapest").alias("cost_usd"))
    joined = sums.join(fastest, [*CELL, ZONE]).withColumn("fastest_run", run).drop("_least", "_cheapest")
    return joined.withColumn("measured_emissions", _proxy())


def first_zone_rows(table: DataFrame) -> DataFrame:
    """One row per scenario and configuration: that of the first zone."""
    rest = [c for c in table.columns if c not in CELL and c != ZONE]
    return table.groupBy(*CELL).agg(F.min(F.struct(ZONE, *rest)).alias("_row")).select(*CELL, "_row.*")


def _means_without(part: list[str], rest: list[str], table: DataFrame) -> DataFrame:
    """Sums over part minus the sums of the row's own (part and rest) cell, as means."""
    sums = [F.sum(c).alias(c) for c in ("runs", "runtime_sum", "cost_sum")]
    own = table.groupBy(*part, *rest).agg(*sums)
    whole = table.groupBy(*part).agg(*[F.sum(c).alias(f"_{c}") for c in ("runs", "runtime_sum", "cost_sum")])
    left = F.col("_runs") - F.col("runs")
    joined = own.join(whole, part)
    return joined.select(
        *part, *rest,
        *[
            F.when(left > 0, F.round((F.col(f"_{t}_sum") - F.col(f"{t}_sum")) / left, _DIGITS)).alias(f"{t}_hat")
            for t in ("runtime", "cost")
        ],
    )


def scenario_left_out_means(table: DataFrame) -> DataFrame:
    """Per scenario: number of other runs and their mean runtime and cost."""
    own = table.groupBy(*fv.SCENARIO).agg(*[F.sum(c).alias(c) for c in ("runs", "runtime_sum", "cost_sum")])
    total = own.agg(F.struct(*[F.sum(c).alias(c) for c in ("runs", "runtime_sum", "cost_sum")])).scalar()
    left = total["runs"] - F.col("runs")
    return own.select(
        *fv.SCENARIO,
        left.alias("training_rows"),
        *[
            F.when(left > 0, F.round((total[f"{t}_sum"] - F.col(f"{t}_sum")) / left, _DIGITS)).alias(f"{t}_other")
            for t in ("runtime", "cost")
        ],
    )


def historical_mean(table: DataFrame) -> DataFrame:
    """Mean runtime and cost of each configuration over all other scenarios, else of all other runs."""
    by_config = _means_without(fv.CONFIG, fv.SCENARIO, table)
    return by_config.join(scenario_left_out_means(table), fv.SCENARIO).select(
        *CELL,
        measures.clamped_runtime(F.coalesce("runtime_hat", "runtime_other")).alias("historical_runtime"),
        measures.clamped_cost(F.coalesce("cost_hat", "cost_other")).alias("historical_cost"),
    )


def _nearest_other_size(table: DataFrame, keys: list[str]) -> DataFrame:
    """The fastest run of the nearest other dataset size within keys; ties go to the smaller size.

    Only the sizes next to each other in order are compared (lag and lead over
    one row per size), never all pairs.
    """
    sizes = table.groupBy(*keys, "dataset_size_mb").agg(F.min("fastest_run").alias("run"))
    ordered = Window.partitionBy(*keys).orderBy("dataset_size_mb")
    row = F.struct("dataset_size_mb", "run")
    sides = sizes.withColumns({"_lower": F.lag(row).over(ordered), "_upper": F.lead(row).over(ordered)})
    below = F.col("dataset_size_mb") - F.col("_lower.dataset_size_mb")
    above = F.col("_upper.dataset_size_mb") - F.col("dataset_size_mb")
    picked = F.when(below.isNull() | (above < below), F.col("_upper.run")).otherwise(F.col("_lower.run"))
    return sides.select(*keys, "dataset_size_mb", picked.alias("_near"))


def nearest_size(table: DataFrame) -> DataFrame:
    """Prediction from the nearest size: same configuration and workload, else same workload, else all other runs."""
    own = _nearest_other_size(table, ["workload_type", *fv.CONFIG]).withColumnRenamed("_near", "_own")
    any_config = _nearest_other_size(table, ["workload_type"]).withColumnRenamed("_near", "_any")
    joined = own.join(any_config, fv.SCENARIO).join(scenario_left_out_means(table), fv.SCENARIO)
    return joined.select(
        *CELL,
        measures.clamped_runtime(F.coalesce("_own.runtime_minutes", "_any.runtime_minutes", "runtime_other")).alias("nearest_runtime"),
        measures.clamped_cost(F.coalesce("_own.cost_usd", "_any.cost_usd", "cost_other")).alias("nearest_cost"),
    )


def sla_thresholds(truth: DataFrame) -> DataFrame:
    """Runtime quantiles of the measured configurations, one row per scenario and level."""
    wide = exact_quantiles(truth, fv.SCENARIO, "measured_runtime_minutes", fv.SLA_LEVELS)
    return wide.unpivot(fv.SCENARIO, list(fv.SLA_LEVELS), "sla_level", "sla")


def best_feasible(truth: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Least cost, runtime and emissions and the optimal configuration within each SLA."""
    feasible = truth.join(thresholds, fv.SCENARIO).filter("measured_runtime_minutes <= sla")
    return feasible.groupBy(*fv.SCENARIO, "sla_level", "sla").agg(
        F.count(F.lit(1)).alias("feasible_candidates"),
        F.min("measured_cost_usd").alias("best_cost"),
        F.min("measured_runtime_minutes").alias("best_runtime"),
        F.min("measured_emissions").alias("best_emissions"),
        F.min(F.struct("measured_cost_usd", F.struct(*fv.CONFIG).alias("config"))).config.alias("optimal"),
    )


def seeded_order(seed: int, *cols: str) -> Column:
    """A repeatable random position in [0, 2^32) that does not depend on the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")


def method_rows(candidates: DataFrame, models: list[str], seed: int = 42) -> DataFrame:
    """One row per candidate and method with its prediction and sort key.

    The sort key is (first, second): predicted cost and runtime; for the
    largest cluster, nodes descending and cost; for random, a seeded hash.
    """
    hist = ("historical_runtime", "historical_cost")
    sources = {"historical_mean": hist, "nearest_size": ("nearest_runtime", "nearest_cost"), "largest_cluster": hist, "random": hist}
    sources = {**{f"model_{m}": (f"{m}_runtime", f"{m}_cost") for m in models}, **sources}

    def entry(method: str, runtime: str, cost: str) -> Column:
        first, second = F.col(cost), F.col(runtime)
        if method == "largest_cluster":
            first, second = -F.col("nodes").cast("double"), F.col(cost)
        elif method == "random":
            first, second = seeded_order(seed, *CELL), F.lit(0.0)
        return F.struct(
            F.lit(method).alias("method"), F.col(runtime).alias("predicted_runtime_minutes"),
            F.col(cost).alias("predicted_cost_usd"), first.alias("first"), second.alias("second"),
        )

    rows = F.explode(F.array(*[entry(m, *pair) for m, pair in sources.items()]))
    keep = [*CELL, "measured_runtime_minutes", "measured_cost_usd", "measured_emissions"]
    return candidates.select(*keep, rows.alias("_m")).select(*keep, "_m.*")


def evaluable_scenarios(table: DataFrame, min_candidates: int = fv.MIN_CANDIDATES, min_rows: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """Scenarios with enough candidates and enough runs outside them."""
    counts = table.groupBy(*fv.SCENARIO).agg(F.count(F.lit(1)).alias("candidate_rows"))
    return counts.join(scenario_left_out_means(table), fv.SCENARIO).filter(
        (F.col("candidate_rows") >= min_candidates) & (F.col("training_rows") >= min_rows)
    )


def skipped_scenarios(table: DataFrame, min_candidates: int = fv.MIN_CANDIDATES, min_rows: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """Scenarios left out of the evaluation and why."""
    counts = table.groupBy(*fv.SCENARIO).agg(F.count(F.lit(1)).alias("candidate_rows"))
    few = F.col("candidate_rows") < min_candidates
    why = F.when(few, F.format_string("only %d configs", "candidate_rows")).otherwise(
        F.format_string("only %d training rows", "training_rows")
    )
    return (
        counts.join(scenario_left_out_means(table), fv.SCENARIO)
        .filter(few | (F.col("training_rows") < min_rows))
        .select(*fv.SCENARIO, why.alias("reason"))
    )


def quality_detail(
    runs: DataFrame,
    model_predictions: dict[str, DataFrame] | None = None,
    seed: int = 42,
    min_candidates: int = fv.MIN_CANDIDATES,
) -> DataFrame:
    """One row per scenario, SLA level and method: the chosen configuration, its regrets and hits.

    model_predictions maps a model name to a table keyed by scenario and
    configuration with <name>_runtime and <name>_cost, fitted without that scenario.
    """
    models = model_predictions or {}
    table = stage(cells(runs), "cells")
    allowed = evaluable_scenarios(table, min_candidates).select(*fv.SCENARIO)
    truth = first_zone_rows(table).join(allowed, fv.SCENARIO, "left_semi")
    candidates = truth.join(historical_mean(table), CELL).join(nearest_size(table), CELL)
    for predictions in models.values():
        candidates = candidates.join(predictions, CELL)
    candidates = stage(candidates, "candidates")
    best = stage(best_feasible(candidates, sla_thresholds(candidates)), "best")

    scope = [*fv.SCENARIO, "sla_level", "method"]
    config = F.struct(*fv.CONFIG)
    offered = method_rows(candidates, list(models), seed).join(best, fv.SCENARIO)
    offered = offered.withColumns({
        "feasible": F.col("predicted_runtime_minutes") <= F.col("sla"),
        "is_optimal": reduce(lambda a, b: a & b, [F.col(c) == F.col(f"optimal.{c}") for c in fv.CONFIG]),
        # Without a feasible candidate the rows come in order of predicted runtime, which settles equal keys.
        "among_feasible": F.struct("first", "second", F.lit(0.0).alias("third"), *fv.CONFIG),
        "among_all": F.struct("first", "second", F.col("predicted_runtime_minutes").alias("third"), *fv.CONFIG),
    })
    measured = F.struct("measured_runtime_minutes", "measured_cost_usd", "measured_emissions")
    bests = ["sla", "feasible_candidates", "best_cost", "best_runtime", "best_emissions"]
    chosen = offered.groupBy(*scope).agg(
        *[F.first(c).alias(c) for c in bests],
        F.count(F.lit(1)).alias("candidates"),
        F.max("feasible").alias("any_feasible"),
        F.min(F.when(F.col("feasible"), F.struct(F.col("among_feasible").alias("k"), measured.alias("m")))).alias("_feasible"),
        F.min(F.struct(F.col("among_all").alias("k"), measured.alias("m"))).alias("_all"),
        F.min(F.when(F.col("is_optimal") & F.col("feasible"), F.col("among_feasible"))).alias("optimal_feasible"),
        F.min(F.when(F.col("is_optimal"), F.col("among_all"))).alias("optimal_all"),
    )
    chosen = stage(
        chosen.withColumns({
            "pick": F.when(F.col("any_feasible"), F.col("_feasible")).otherwise(F.col("_all")),
            "optimal_key": F.when(F.col("any_feasible"), F.col("optimal_feasible")).otherwise(F.col("optimal_all")),
        }).drop("_feasible", "_all", "optimal_feasible", "optimal_all"),
        "chosen",
    )
    ahead = (
        offered.select(*scope, "feasible", "among_feasible", "among_all")
        .join(chosen.filter("optimal_key is not null").select(*scope, "any_feasible", "optimal_key"), scope)
        .groupBy(*scope)
        .agg(F.count_if(
            F.when(F.col("any_feasible"), F.col("feasible") & (F.col("among_feasible") < F.col("optimal_key")))
            .otherwise(F.col("among_all") < F.col("optimal_key"))
        ).alias("ahead"))
    )
    measured_runtime, measured_cost = F.col("pick.m.measured_runtime_minutes"), F.col("pick.m.measured_cost_usd")
    regret = measures.regret_pct
    return chosen.join(ahead, scope, "left").select(
        *fv.SCENARIO,
        "sla_level",
        F.round("sla", 4).alias("sla_minutes"),
        "method",
        "candidates",
        "feasible_candidates",
        *[F.col(f"pick.k.{c}").alias(f"chosen_{c}") for c in fv.CONFIG],
        F.coalesce((F.col("ahead") == 0).cast("int"), F.lit(0)).alias("top1_correct"),
        F.coalesce((F.col("ahead") < 3).cast("int"), F.lit(0)).alias("top3_correct"),
        F.round(regret(measured_cost, F.col("best_cost")), 4).alias("cost_regret_pct"),
        F.round(regret(measured_runtime, F.col("best_runtime")), 4).alias("runtime_regret_pct"),
        F.round(regret(F.col("pick.m.measured_emissions"), F.col("best_emissions")), 4).alias("carbon_regret_pct"),
        ((measured_runtime > F.col("sla")) & F.col("any_feasible")).cast("int").alias("sla_violation"),
        (~F.col("any_feasible")).cast("int").alias("no_feasible_prediction"),
        F.round(measured_runtime, 4).alias("measured_runtime_minutes"),
        F.round(measured_cost, 6).alias("measured_cost_usd"),
    )


def quality_summary(detail: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Ten measures by method and SLA level, in the order of methods and levels."""
    methods = [*[f"model_{m}" for m in models or []], *fv.BASELINE_METHODS]
    scope = ["method", "sla_level"]
    means = {
        "top1_accuracy": "top1_correct", "top3_hit_rate": "top3_correct", "mean_cost_regret_pct": "cost_regret_pct",
        "mean_runtime_regret_pct": "runtime_regret_pct", "mean_carbon_regret_pct": "carbon_regret_pct",
        "sla_violation_rate": "sla_violation", "infeasible_rate": "no_feasible_prediction",
    }
    detail = stage(detail, "detail")
    summary = detail.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("scenarios"),
        *[F.round(F.avg(c), 4).alias(name) for name, c in means.items()],
        F.round(F.max("cost_regret_pct"), 4).alias("max_cost_regret_pct"),
    )
    medians = exact_quantiles(detail, scope, "cost_regret_pct", {"median_cost_regret_pct": 0.5})
    return (
        summary.join(medians.withColumn("median_cost_regret_pct", F.round("median_cost_regret_pct", 4)), scope)
        .orderBy(position_in(methods, "method"), position_in(list(fv.SLA_LEVELS), "sla_level"))
    )


def position_in(names: list[str], column: str) -> Column:
    """Ordinal of a label in a fixed list; labels outside it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0).cast("bigint")), F.lit(len(names) + 1).cast("bigint"))


def search_space(truth: DataFrame) -> DataFrame:
    per_scenario = truth.groupBy(*fv.SCENARIO).agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs"))
    return per_scenario.agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.round(F.avg("n"), 2).alias("configurations_per_scenario_mean"),
        F.max("n").alias("configurations_per_scenario_max"),
        F.sum("runs").alias("benchmark_runs_in_dataset"),
        F.lit(0).alias("runs_required_by_recommender_at_inference"),
    )
