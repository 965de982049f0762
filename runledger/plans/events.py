"""The three event-log workloads: scoring, per-user profiles, partitioned rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import stage
from runledger.sources.readers import read_events
from runledger.sources.sinks import write_by_region, write_measured

PROFILE_KEYS = 50_000
BUCKET_BYTES = 250


def score(step: int) -> Column:
    """Score of the given iteration, counted from 0."""
    return F.sqrt(F.col("response_time_ms") * F.col("payload_size") + F.lit(step + 1)) + F.log1p(F.col("user_id") % 1000)


def scored_events(events: DataFrame, iterations: int = 8) -> DataFrame:
    return events.select("*", *[score(i).alias(f"score_{i}") for i in range(iterations)])


def event_scores(events: DataFrame, iterations: int = 8) -> DataFrame:
    """Count, mean latency, total payload and mean last score by region and event type."""
    return (
        events.groupBy("region", "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.avg("response_time_ms").alias("avg_response_ms"),
            F.sum("payload_size").alias("total_payload"),
            F.avg(score(iterations - 1)).alias("avg_score"),
        )
        .orderBy("region", "event_type")
    )


def bucketed_events(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % PROFILE_KEYS).alias("join_key"),
        "region", "event_type", "response_time_ms",
        F.floor(F.col("payload_size") / BUCKET_BYTES).alias("payload_bucket"),
        "amount_usd",
    )


def user_profiles(events: DataFrame) -> DataFrame:
    """Events, mean latency and revenue per profile key."""
    return bucketed_events(events).groupBy("join_key").agg(
        F.count(F.lit(1)).alias("user_events"),
        F.avg("response_time_ms").alias("user_avg_response"),
        F.sum("amount_usd").alias("user_revenue"),
    )


def profile_rollup(events: DataFrame) -> DataFrame:
    """Profile latency and revenue by region, event type and payload bucket, every event carrying its key's profile.

    The events are read and shuffled once, into partial sums per key and output
    group. Those are written, since both the profiles and the roll-up need them
    and column pruning would otherwise make two different scans of the events.
    A profile is constant within its key, so weighting it by the group's count
    equals joining it to every event. The broadcast is bounded by the at most
    2 x 50,000 - 1 keys (remainders of a signed number).
    """
    group = ["region", "event_type", "payload_bucket"]
    parts = stage(
        bucketed_events(events).filter("join_key is not null").groupBy("join_key", *group).agg(
            F.count(F.lit(1)).alias("n"),
            F.count("response_time_ms").alias("timed"),
            F.sum("response_time_ms").alias("latency"),
            F.sum("amount_usd").alias("revenue"),
        ),
        "profile-parts",
    )
    profile = parts.groupBy("join_key").agg(
        (F.sum("latency") / F.nullif(F.sum("timed"), F.lit(0).cast("bigint"))).alias("user_avg_response"),
        F.sum("revenue").alias("user_revenue"),
    )
    weighted = F.sum(F.col("user_avg_response") * F.col("n"))
    weight = F.sum(F.when(F.col("user_avg_response").isNotNull(), F.col("n")))
    return parts.join(F.broadcast(profile), "join_key").groupBy(*group).agg(
        F.sum("n").alias("events"),
        (weighted / weight).alias("avg_profile_response"),
        F.sum(F.col("user_revenue") * F.col("n")).alias("profile_revenue"),
    )


def daily_bytes(events: DataFrame) -> DataFrame:
    return events.groupBy("region", "event_date").agg(
        F.count(F.lit(1)).alias("events"), F.sum("payload_size").alias("bytes_processed")
    )


def partitioned_rewrite(events: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write the events by region in time order, then total them by region and day from the written files."""
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    return daily_bytes(write_by_region(dated, path, files))


def run_workload(spark: SparkSession, workload: str, input_path: str, output_path: str, metrics_path: str | None = None) -> DataFrame:
    """One workload as a job: read the event log, compute, write the result, return (and append) its metric row.

    The io-heavy job leaves its partitioned copy of the events beside the result.
    """
    events = read_events(spark, input_path)
    if workload == "cpu-heavy":
        result = event_scores(events)
    elif workload == "memory-heavy":
        result = profile_rollup(events)
    elif workload == "io-heavy":
        result = partitioned_rewrite(events, f"{output_path.rstrip('/')}-events")
    else:
        raise ValueError(f"unknown workload: {workload}")
    return write_measured(result, output_path, workload, input_path, metrics_path)
