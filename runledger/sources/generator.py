"""Synthetic event log of any size, generated in parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as fv

BYTES_PER_CSV_ROW = 80  # mean width of a line as Spark writes it


def rows_for_size(target_mb: float) -> int:
    """Rows of roughly target_mb of CSV."""
    return math.ceil(target_mb * 1024 * 1024 / BYTES_PER_CSV_ROW)


def _pick(names: list[str], seed: int) -> Column:
    position = F.floor(F.rand(seed) * len(names)).cast("int")
    return F.get(F.array(*[F.lit(n) for n in names]), position)


def _whole(low: int, high: int, seed: int) -> Column:
    """Uniform whole number in [low, high)."""
    return F.lit(low) + F.floor(F.rand(seed) * (high - low))


def generate_events(ids: DataFrame, seed: int = 42) -> DataFrame:
    """One event per row of ids (spark.range, or any table): log-normal payloads, clipped
    normal latency, 15 % purchases and 4 % errors."""
    second = F.floor(F.rand(seed) * (fv.EVENT_DAYS * 86400))
    payload = F.floor(F.exp(F.lit(6.0) + F.lit(0.8) * F.randn(seed + 1)))
    latency = F.lit(180.0) + F.lit(75.0) * F.randn(seed + 2)
    # A gamma variable of shape 3 is a sum of three exponential ones.
    spend = F.lit(-20.0) * F.log((1 - F.rand(seed + 3)) * (1 - F.rand(seed + 4)) * (1 - F.rand(seed + 5)))
    return ids.select(
        F.timestamp_seconds(F.unix_timestamp(F.lit(fv.EVENT_START)) + second).alias("timestamp"),
        _whole(1000, 2_000_000, seed + 6).cast("bigint").alias("user_id"),
        _whole(10_000, 99_999_999, seed + 7).cast("bigint").alias("session_id"),
        _pick(fv.EVENT_REGIONS, seed + 8).alias("region"),
        _pick(fv.EVENT_TYPES, seed + 9).alias("event_type"),
        _pick(fv.DEVICE_TYPES, seed + 10).alias("device_type"),
        F.round(F.greatest(F.lit(5.0), F.least(F.lit(2500.0), latency)), 2).alias("response_time_ms"),
        F.greatest(F.lit(80), F.least(F.lit(5000), payload)).cast("int").alias("payload_size"),
        F.round(F.when(F.rand(seed + 11) < 0.15, spend).otherwise(F.lit(0.0)), 2).alias("amount_usd"),
        F.when(F.rand(seed + 12) < 0.04, _whole(400, 599, seed + 13)).otherwise(F.lit(0)).cast("int").alias("error_code"),
    )
