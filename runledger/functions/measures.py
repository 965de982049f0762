"""Cost, runtime and emissions arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions.labels import key, literal_map


def run_cost(hourly_usd: Column, nodes: Column, minutes: Column, digits: int = 6) -> Column:
    return F.round(hourly_usd * nodes * (minutes / 60.0), digits)


def elapsed_minutes(started: Column, ended: Column) -> Column:
    seconds = (F.unix_micros(ended) - F.unix_micros(started)) / 1e6
    return F.round(seconds / 60.0, 6)


def service_minutes(execution_ms: Column, setup_ms: Column, cleanup_ms: Column, start_ms: Column, end_ms: Column) -> Column:
    """Sum of the reported phases; without any, the span from start to end."""
    zero = F.lit(0)
    phases = sum((F.coalesce(c, zero) for c in (execution_ms, setup_ms, cleanup_ms)), zero)
    span = F.greatest(F.coalesce(end_ms, zero) - F.coalesce(start_ms, zero), zero)
    return F.round(F.when(phases > 0, phases).otherwise(span) / 60000.0, 6)


def emissions_proxy(minutes: Column, intensity: Column) -> Column:
    return (minutes / 60.0) * intensity


def pue(cloud: Column) -> Column:
    return F.coalesce(literal_map(fv.PUE)[key(cloud)], F.lit(fv.DEFAULT_PUE))


def energy_kwh(power_w: Column, nodes: Column, minutes: Column) -> Column:
    return (power_w * nodes / 1000.0) * (minutes / 60.0)


def emissions(power_w: Column, nodes: Column, minutes: Column, intensity: Column, cloud: Column) -> Column:
    return energy_kwh(power_w, nodes, minutes) * intensity * pue(cloud)


def clamped_runtime(col: Column) -> Column:
    """At least the shortest runtime; a missing prediction stays missing (greatest() would skip the null)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(fv.MIN_RUNTIME)))


def clamped_cost(col: Column) -> Column:
    """At least zero; a missing prediction stays missing."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(0.0)))


def regret_pct(chosen: Column, best: Column) -> Column:
    """Excess over the best in percent; zero where the best is not positive."""
    return F.when(best > 0, (chosen - best) / best * 100.0).otherwise(F.lit(0.0))


def mean_of(col: Column | str, digits: int = 9) -> Column:
    """Average rounded far below the data's precision.

    A distributed float sum depends on the task order in its last bits. Averages
    that are later compared with each other (dominance, argmin, thresholds) are
    rounded so that a re-run cannot turn an equality into an inequality.
    """
    return F.round(F.avg(col), digits)
