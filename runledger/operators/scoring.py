"""Scoring and ranking of candidate configurations for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels, measures
from runledger.session import stage

REQUEST = ["request_id"]
_TIE = ["cloud", "region", "machine_type", "nodes", "electricity_zone"]


def min_max(value: Column, window) -> Column:
    """0 for the least, 1 for the greatest; all 0 where they are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))


def ratio_to_best(value: Column, window, higher_is_better: bool = False) -> Column:
    """Proportional gap to the best value; min-max where the best is not positive and finite."""
    best = (F.max if higher_is_better else F.min)(value).over(window)
    gap = (best - value) / best if higher_is_better else (value - best) / best
    usable = (best > 0) & (best < F.lit(float("inf")))
    return F.when(usable, gap).otherwise(min_max(value, window))


def goal_score(goal: Column, window) -> Column:
    """Score by goal; lower is better."""
    runtime, cost = F.col("predicted_runtime_minutes"), F.col("predicted_cost_usd")
    emitted, renewable = F.col("predicted_emissions_gco2eq"), F.col("renewable_percentage_mean")
    w = fv.BALANCED_WEIGHTS
    distance = F.sqrt(
        F.lit(w["runtime"]) * F.pow(ratio_to_best(runtime, window), F.lit(2.0))
        + F.lit(w["cost"]) * F.pow(ratio_to_best(cost, window), F.lit(2.0))
        + F.lit(w["emissions"]) * F.pow(ratio_to_best(emitted, window), F.lit(2.0))
        + F.lit(w["renewable"]) * F.pow(ratio_to_best(renewable, window, higher_is_better=True), F.lit(2.0))
    )
    penalty = F.lit(fv.RENEWABLE_WEIGHT) * (F.lit(1.0) - min_max(renewable, window))
    return (
        F.when(goal == "cost", min_max(cost, window))
        .when(goal == "runtime", min_max(runtime, window))
        .when(goal == "carbon", min_max(emitted, window) + penalty)
        .otherwise(distance)
    )


def _sort_keys(goal: Column, digits: int) -> list[Column]:
    """Goal-specific tie-breakers as common sort positions, ending in the configuration key."""
    score = F.round("optimization_score", digits)
    cost, runtime = F.col("predicted_cost_usd"), F.col("predicted_runtime_minutes")
    emitted, intensity = F.col("predicted_emissions_gco2eq"), F.col("carbon_intensity_mean")
    less_renewable = -F.col("renewable_percentage_mean")
    none = F.lit(0.0)
    orders = {
        "cost": [score, cost, runtime, intensity, less_renewable, none],
        "runtime": [score, runtime, cost, intensity, less_renewable, none],
        "carbon": [score, emitted, intensity, less_renewable, cost, runtime],
        "balanced": [score, emitted, cost, runtime, none, none],
    }
    keys = []
    for position in range(6):
        choice = F.lit(None).cast("double")
        for name in reversed(fv.GOALS):
            choice = F.when(goal == name, orders[name][position]).otherwise(choice)
        keys.append(choice.asc_nulls_last())
    return [*keys, *[F.col(c).asc_nulls_last() for c in _TIE]]


def within_sla(scored: DataFrame, keys: list[str] = REQUEST) -> DataFrame:
    """Candidates meeting the request's SLA; all of them, flagged no_sla_match, where none does.

    A request with a null SLA has no limit: every candidate meets it.
    """
    meets = F.col("sla_runtime_minutes").isNull() | F.coalesce(F.col("predicted_runtime_minutes") <= F.col("sla_runtime_minutes"), F.lit(False))
    any_meets = F.max(meets).over(Window.partitionBy(*keys))
    return (
        scored.withColumns({"sla_valid": meets, "no_sla_match": ~any_meets})
        .filter("sla_valid or no_sla_match")
    )


def rank_candidates(scored: DataFrame, keys: list[str] = REQUEST, digits: int = 12) -> DataFrame:
    """Score, rank and explain the candidates of every request.

    All windows share the request as partition key, so the expanded rows are
    shuffled once at most, and not at all when requests were partitioned by
    it before the candidates were joined on.
    """
    window = Window.partitionBy(*keys)
    goal = F.col("goal")
    scored = within_sla(scored, keys).withColumn("optimization_score", goal_score(goal, window))
    rank = F.row_number().over(window.orderBy(*_sort_keys(goal, digits)))
    return scored.withColumns({"rank": rank, "recommendation_reason": labels.reason(goal, F.col("no_sla_match"))})


def top_n(ranked: DataFrame, n: int = 5) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return ranked.filter(F.col("rank") <= n)


def candidate_configs(runs: DataFrame) -> DataFrame:
    """Configurations seen per workload, with the run-weighted carbon means of their region."""
    carbon = runs.groupBy("cloud", "region").agg(
        measures.mean_of("carbon_intensity_mean").alias("carbon_intensity_mean"),
        measures.mean_of("renewable_percentage_mean").alias("renewable_percentage_mean"),
    )
    configs = runs.select("workload_type", *fv.CONFIG, "electricity_zone").distinct()
    return configs.join(carbon, ["cloud", "region"], "left")


def expand_requests(requests: DataFrame, candidates: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every request with all candidates of its workload.

    Requests are spread by request_id first: joined with a broadcast side the
    rows keep that partitioning, and the later windows need no shuffle of the
    expanded rows. The number of tasks is stated because the adaptive planner
    would size them by the few request rows, not by what they expand to.
    """
    tasks = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(tasks, "request_id").join(candidates, "workload_type")


def with_effective_sla(requests: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """effective_sla: the greatest predicted runtime of the request's candidates that its SLA admits, null if none.

    Requests of equal workload, goal and effective SLA admit the same candidates
    and so share one ranking. A null SLA admits all candidates. Each distinct
    (keys, SLA) is looked up once, however many requests have it: SLAs and
    runtimes are range-split together, and each range carries its last runtime
    on; the last runtimes of earlier ranges are a table of one row per key and
    range.
    """
    asked = F.coalesce(F.col("sla_runtime_minutes").cast("double"), F.lit(float("inf")))
    slas = requests.select(*keys, asked.alias("_at")).distinct().withColumn("_runtime", F.lit(None).cast("double"))
    runtimes = scored.filter(F.col("predicted_runtime_minutes").isNotNull()).select(*keys, F.col("predicted_runtime_minutes").cast("double").alias("_at")).distinct()
    both = runtimes.withColumn("_runtime", F.col("_at")).unionByName(slas)
    order = [*keys, "_at", F.col("_runtime").asc_nulls_last()]
    placed = both.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range", *keys).orderBy("_at", F.col("_runtime").asc_nulls_last())
    placed = stage(placed.withColumn("_last", F.last("_runtime", ignorenulls=True).over(within)), "slas")
    ranges = placed.groupBy("_range", *keys).agg(F.max("_runtime").alias("_most"))
    carried = ranges.withColumn("_carried", F.max("_most").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    looked_up = placed.filter("_runtime IS NULL").join(carried, ["_range", *keys]).select(*keys, "_at", F.coalesce("_last", "_carried").alias("effective_sla"))
    return requests.withColumn("_at", asked).join(stage(looked_up, "effective-slas"), [*keys, "_at"]).drop("_at")


def predicted_emissions(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "predicted_emissions_gco2eq",
        measures.emissions(
            F.col("power_w"), F.col("nodes"), F.col("predicted_runtime_minutes"), F.col("carbon_intensity_mean"), F.col("cloud")
        ),
    )


def report(ranked: DataFrame, digits: int = 4) -> DataFrame:
    """Display columns, numbers rounded."""
    numbers = {
        "predicted_runtime_minutes", "predicted_cost_usd", "predicted_emissions_gco2eq", "carbon_intensity_mean",
        "renewable_percentage_mean", "optimization_score",
    }
    return ranked.select(
        *[c for c in REQUEST if c in ranked.columns],
        *[
            (F.round(c, digits) if c in numbers else F.col(c)).alias(heading)
            for c, heading in fv.REPORT_HEADINGS.items()
        ],
    )
