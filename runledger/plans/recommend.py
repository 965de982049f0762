"""Recommendations for tables of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels, measures
from runledger.operators import cleaning, enrich, scoring
from runledger.session import stage

Predictor = Callable[[DataFrame], DataFrame]


def workload_means(runs: DataFrame) -> DataFrame:
    """Mean runtime and cost of each configuration per workload, as predictions for any dataset size."""
    return runs.groupBy("workload_type", *fv.CONFIG).agg(
        measures.clamped_runtime(measures.mean_of("runtime_minutes")).alias("predicted_runtime_minutes"),
        measures.clamped_cost(measures.mean_of("cost_usd")).alias("predicted_cost_usd"),
    )


def scored_candidates(runs: DataFrame, power: DataFrame | None, vcpus: DataFrame | None = None, predictor: Predictor | None = None) -> DataFrame:
    """Candidates per workload with predictions, power and emissions.

    Without a predictor the workload means are used. Written once: its size
    decides whether requests meet it by broadcast.
    """
    candidates = scoring.candidate_configs(runs)
    predict = predictor or (lambda c: c.join(workload_means(runs), ["workload_type", *fv.CONFIG]))
    powered = enrich.attach_power(predict(candidates), power, vcpus)
    return stage(scoring.predicted_emissions(powered), "scored-candidates")


def recommend(requests: DataFrame, scored: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates of every request.

    requests has request_id, workload_type, dataset_size_mb, sla_runtime_minutes,
    goal. If scored has dataset_size_mb (a size-aware predictor), sizes must match too.

    What a request gets depends on its goal and on which candidates its SLA
    admits, and an SLA admits a prefix of the candidates in order of runtime.
    So each (scenario, goal, prefix) is ranked once, however many requests
    share it, and the requests only look their list up: they are neither
    expanded nor ranked one by one. Candidates without a predicted runtime or
    cost can't be ranked and are left out (unpredicted_candidates lists them);
    requests of a workload without candidates get no row (unknown_requests
    lists them). A null SLA admits every candidate.
    """
    keys, placed, classes = _classes(requests, scored)
    ranked = scoring.top_n(classes, n).drop("requests")
    found = stage(ranked.drop("sla_runtime_minutes"), "ranked").withColumnRenamed("effective_sla", "_effective")
    same = F.col("effective_sla").eqNullSafe(F.col("_effective"))
    for name in (*keys, "goal"):
        found = found.withColumnRenamed(name, f"_{name}")
        same = same & (F.col(name) == F.col(f"_{name}"))
    return placed.join(found, same).drop("_effective", "effective_sla", *[f"_{k}" for k in (*keys, "goal")])


def answers(requests: DataFrame, scored: DataFrame, n: int = 5) -> DataFrame:
    """Every request with its n best candidates, or with the reason why it has none.

    The rows of `recommend` with a status ("ok", or "no_valid_configuration" if
    none meets the SLA and all compete) and, for requests that can't be ranked,
    one row without a candidate: "unknown_workload" (also a null one) or
    "no_predicted_configuration". candidates and unpredicted count what the
    request's workload has and what of it couldn't compete.
    """
    keys = fv.SCENARIO if "dataset_size_mb" in scored.columns else ["workload_type"]
    missing = F.col("predicted_runtime_minutes").isNull() | F.col("predicted_cost_usd").isNull()
    offered = stage(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(missing).alias("unpredicted")), "offered")
    ranked = recommend(requests, scored, n).withColumn("status", F.when(F.col("no_sla_match"), "no_valid_configuration").otherwise("ok")).join(offered, keys)
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("candidates", "unpredicted")}
    rest = requests.withColumn("goal", labels.goal("goal")).join(offered, keys, "left").withColumns(counts).filter("candidates = unpredicted")
    rest = rest.withColumn("status", F.when(F.col("candidates") == 0, "unknown_workload").otherwise("no_predicted_configuration"))
    return ranked.unionByName(rest, allowMissingColumns=True)


def _classes(requests: DataFrame, scored: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """The scenario's keys, the requests with their effective SLA, and every candidate ranked once for each (scenario, goal, effective SLA)."""
    scored = scored.filter("predicted_runtime_minutes IS NOT NULL AND predicted_cost_usd IS NOT NULL")
    asked = requests.withColumn("goal", labels.goal("goal"))
    keys = fv.SCENARIO if "dataset_size_mb" in scored.columns else ["workload_type"]
    placed = scoring.with_effective_sla(asked, scored, keys)
    group = [*keys, "goal", "effective_sla"]
    classes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("requests"))
    classes = classes.withColumn("sla_runtime_minutes", F.coalesce("effective_sla", F.lit(-1.0)))
    expanded = classes.repartition(_tasks(classes), *group).join(scored, keys)
    return keys, placed, scoring.rank_candidates(expanded, group)


def ranked_classes(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """Every candidate with its score and rank, once for all requests that admit the same candidates for the same goal; `requests` counts these."""
    return _classes(requests, scored)[2]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best_candidate(requests: DataFrame, scored: DataFrame) -> DataFrame:
    return recommend(requests, scored, 1)


def unpredicted_candidates(scored: DataFrame) -> DataFrame:
    """Candidates that no request can be offered, because their predicted runtime or cost is missing."""
    return scored.filter("predicted_runtime_minutes IS NULL OR predicted_cost_usd IS NULL")


def unknown_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests whose workload no run has."""
    return cleaning.unknown_workloads(requests, runs)


def example_requests(spark, size_mb: float = 1024, sla: float = 5) -> DataFrame:
    """Every workload with every goal, built from the two label lists."""
    workloads = [w for w in fv.VALID_WORKLOADS if "-" in w]
    rows = [(f"{w}_{g}", w, float(size_mb), float(sla), g) for w in workloads for g in fv.GOALS]
    return spark.createDataFrame(rows, "request_id string, workload_type string, dataset_size_mb double, sla_runtime_minutes double, goal string")


def allowed_offers(predictions: DataFrame, priced: DataFrame) -> DataFrame:
    """Predictions with the price and category of their candidate, where the workload allows the category (a workload without a list allows all)."""
    allowed = labels.literal_map({w: "|".join(c) for w, c in fv.CATEGORIES_BY_WORKLOAD.items()})[F.col("workload_type")]
    fits = allowed.isNull() | F.array_contains(F.split(allowed, r"\|"), F.col("category"))
    return predictions.join(priced, ["instance_type", "nodes"]).filter(fits)


def cheapest_within_sla(requests: DataFrame, priced: DataFrame, predictions: DataFrame) -> DataFrame:
    """Price-based choice per request: cheapest candidate within the SLA, else the fastest.

    priced has instance_type, nodes, category, hourly_price_usd; predictions has
    workload_type, instance_type, nodes, predicted_runtime_minutes and
    model_predicted_cost_usd. Only the categories allowed for the workload compete.
    Requests look their prefix of the candidates up and never meet the candidates themselves.
    Candidates without a price or a predicted runtime compete for neither; a
    request that has no other is answered "no_priced_configuration", and one of
    an unknown workload "unknown_workload", both without a choice.
    """
    offered = (
        stage(allowed_offers(predictions, priced), "priced")
        .withColumn("predicted_runtime_minutes", measures.clamped_runtime(F.col("predicted_runtime_minutes")))
    )
    cost = F.round(F.col("hourly_price_usd") * F.col("nodes") * (F.col("predicted_runtime_minutes") / 60.0), 9)
    offered = stage(offered.withColumn("predicted_cost_usd", cost), "offered")
    usable = F.col("predicted_cost_usd").isNotNull() & F.col("predicted_runtime_minutes").isNotNull()
    rest = ["instance_type", "category", "model_predicted_cost_usd"]
    cheapest = F.struct("predicted_cost_usd", "predicted_runtime_minutes", "nodes", *rest)
    fastest = F.struct("predicted_runtime_minutes", "predicted_cost_usd", "nodes", *rest)
    of_workload = offered.groupBy("workload_type").agg(F.min(F.when(usable, fastest)).alias("fastest"), F.count("instance_type").alias("candidates"))
    # An SLA admits a prefix of a workload's candidates in order of runtime: the cheapest so far is known at every runtime.
    so_far = Window.partitionBy("workload_type").orderBy("predicted_runtime_minutes")
    prefixes = offered.filter(usable).select("workload_type", F.col("predicted_runtime_minutes").alias("effective_sla"), F.min(cheapest).over(so_far).alias("cheapest")).distinct()
    asked = requests.select("request_id", "workload_type", "sla_runtime_minutes").distinct()
    placed = scoring.with_effective_sla(asked.filter("workload_type IS NOT NULL"), offered.filter(usable), ["workload_type"])
    nameless = asked.filter("workload_type IS NULL").withColumn("effective_sla", F.lit(None).cast("double"))
    best = placed.unionByName(nameless).join(prefixes, ["workload_type", "effective_sla"], "left").join(of_workload, "workload_type", "left")
    best = best.withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    found = F.col("cheapest").isNotNull()

    def pick(name: str):
        return F.when(found, F.col(f"cheapest.{name}")).otherwise(F.col(f"fastest.{name}")).alias(name)

    return best.select(
        "request_id", "workload_type", "sla_runtime_minutes",
        F.when(found, F.lit("ok")).when(F.col("candidates") == 0, F.lit("unknown_workload")).when(F.col("fastest").isNull(), F.lit("no_priced_configuration"))
        .otherwise(F.lit("no_valid_configuration")).alias("status"),
        "candidates",
        *[pick(c) for c in ("instance_type", "nodes", "category", "predicted_runtime_minutes", "predicted_cost_usd", "model_predicted_cost_usd")],
    )


def fastest_candidates(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n candidates with the least predicted runtime per key."""
    order = Window.partitionBy(*keys).orderBy("predicted_runtime_minutes", *fv.CONFIG)
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
