"""Pareto fronts over three minimised objectives, and the trade-off tables built on them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels, measures
from runledger.session import stage

OBJECTIVES = ["cost_usd", "runtime_minutes", "emissions_gco2eq"]
ZONE = ["electricity_zone"]


def _undominated_rows(scenario: list[str], objectives: list[str]):
    """Filter for rows sorted by scenario and objectives: keeps those no earlier row dominates.

    Memory holds one staircase of (second, third) objective pairs, not the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, previous, verdict = None, None, False
        xs: list[float] = []
        ys: list[float] = []
        for batch in batches:
            keep = []
            points = zip(
                batch[scenario].itertuples(index=False, name=None),
                batch[objectives].itertuples(index=False, name=None),
            )
            for group, point in points:
                if group != current:
                    current, previous, xs, ys = group, None, [], []
                if point != previous:
                    _, x, y = previous = point
                    at = bisect_right(xs, x)
                    verdict = at == 0 or ys[at - 1] > y
                    if verdict:
                        start = at - 1 if at and xs[at - 1] == x else at
                        stop = start
                        while stop < len(ys) and ys[stop] >= y:
                            stop += 1
                        xs[start:stop], ys[start:stop] = [x], [y]
                keep.append(verdict)
            yield batch[keep]

    return run


#: Weights of the three objectives, each against its range, by which strong rows are found: the three alone, pairs, and all in several shares.
_DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1), (4, 1, 1), (1, 4, 1), (1, 1, 4), (1, 4, 4), (4, 1, 4), (4, 4, 1)]


def corner_points(known: DataFrame, scenario: list[str], objectives: list[str]) -> DataFrame:
    """Per scenario a few rows (`_corners`, an array of objective values) that are least in some weighting of the objectives. Two aggregations."""
    ranges = known.groupBy(*scenario).agg(*[F.min(F.col(c).cast("double")).alias(f"_low_{c}") for c in objectives], *[F.max(F.col(c).cast("double")).alias(f"_high_{c}") for c in objectives])
    placed = known.select(*scenario, *objectives).join(stage(ranges, "ranges"), scenario)  # a null scenario has no corners, and keeps its rows
    span = lambda c: F.greatest(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(1e-300))
    share = {c: (F.col(c) - F.col(f"_low_{c}")) / span(c) for c in objectives}
    point = F.struct(*objectives)
    least = [F.min(F.struct(sum((share[c] * w for c, w in zip(objectives, weights, strict=True)), F.lit(0.0)).alias("s"), point.alias("p"))).alias(f"_c{i}") for i, weights in enumerate(_DIRECTIONS)]
    corners = placed.groupBy(*scenario).agg(*least)
    return corners.select(*scenario, F.array_distinct(F.array(*[F.col(f"_c{i}.p") for i in range(len(_DIRECTIONS))])).alias("_corners"))


def _beyond_corners(known: DataFrame, scenario: list[str], objectives: list[str]) -> DataFrame:
    """The rows that no corner point of their scenario dominates."""
    corners = stage(corner_points(known, scenario, objectives), "corners")

    def dominates(p: Column) -> Column:
        no_worse = reduce(lambda a, b: a & b, [p[c] <= F.col(c) for c in objectives])
        return no_worse & reduce(lambda a, b: a | b, [p[c] < F.col(c) for c in objectives])

    renamed = corners.select(*[F.col(c).alias(f"_of_{c}") for c in scenario], "_corners")
    same = reduce(lambda a, b: a & b, [known[c].eqNullSafe(renamed[f"_of_{c}"]) for c in scenario])
    return known.join(renamed, same, "left").filter(~F.coalesce(F.exists("_corners", dominates), F.lit(False))).select(*known.columns)


def pareto_front(df: DataFrame, scenario: list[str] = fv.SCENARIO, objectives: list[str] = OBJECTIVES) -> DataFrame:
    """Rows of each scenario that no other row dominates; equal points all stay.

    Exact steps, none of which pairs up a scenario's rows. First, natively, a few
    strong rows of each scenario (corner_points) drop what they dominate, which
    is most of it. Then every input task drops what its own rows dominate; the
    rest is range-split by scenario and objectives, so that a large scenario
    spans many tasks and a row can only be dominated from its own or an earlier
    range; last, rows are tested against the staircases of earlier ranges of
    their scenario.
    """
    order = [*scenario, *objectives]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in objectives])
    known, unknown = df.filter(complete), df.filter(~complete)  # null or NaN: neither dominates nor is dominated
    known = _beyond_corners(known, scenario, objectives)
    sweep = _undominated_rows(scenario, objectives)
    local = known.sortWithinPartitions(*order).mapInPandas(sweep, known.schema)
    ranged = local.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(sweep, known.schema)
    ranged = stage(ranged.withColumn("_range", F.spark_partition_id()), "pareto")

    _, x, y = objectives
    spans = ranged.groupBy(*scenario).agg(F.min("_range").alias("_first"), F.max("_range").alias("_last"))
    split = spans.filter("_first < _last").select(*scenario)
    stairs = (
        ranged.join(split, scenario, "left_semi")
        .groupBy(*scenario, "_range", x)
        .agg(F.min(y).alias(y))
        .withColumn(
            "_lower",
            F.min(y).over(Window.partitionBy(*scenario, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)),
        )
        .filter(F.col("_lower").isNull() | (F.col(y) < F.col("_lower")))
        .drop("_lower")
    )
    r, s = ranged.alias("r"), stairs.alias("s")
    dominates = (
        reduce(lambda a, b: a & b, [F.col(f"r.{c}") == F.col(f"s.{c}") for c in scenario])
        & (F.col("s._range") < F.col("r._range"))
        & (F.col(f"s.{x}") <= F.col(f"r.{x}"))
        & (F.col(f"s.{y}") <= F.col(f"r.{y}"))
    )
    return r.join(s, dominates, "left_anti").drop("_range").select(*df.columns).unionByName(unknown)


def flag_pareto(df: DataFrame, key: list[str], scenario: list[str] = fv.SCENARIO, objectives: list[str] = OBJECTIVES) -> DataFrame:
    """All rows with on_pareto_front; key identifies a row."""
    front = pareto_front(df, scenario, objectives).select(*key).withColumn("_front", F.lit(True))
    return (
        df.join(front, key, "left")
        .withColumn("on_pareto_front", F.coalesce("_front", F.lit(False)))
        .drop("_front")
        .select(*df.columns, "on_pareto_front")
    )


def with_emissions(df: DataFrame) -> DataFrame:
    """PUE, cluster power, energy and emissions of every run that has power_w."""
    return df.withColumns({
        "pue": measures.pue(F.col("cloud")),
        "cluster_power_kw": F.col("power_w") * F.col("nodes") / 1000.0,
        "energy_kwh": measures.energy_kwh(F.col("power_w"), F.col("nodes"), F.col("runtime_minutes")),
        "emissions_gco2eq": measures.emissions(
            F.col("power_w"), F.col("nodes"), F.col("runtime_minutes"), F.col("carbon_intensity_mean"), F.col("cloud")
        ),
    })


def aggregate_configurations(df: DataFrame) -> DataFrame:
    """One row per scenario, configuration and zone, averaging repeated runs."""
    keys = [*fv.SCENARIO, *fv.CONFIG, *ZONE]
    means = [
        "runtime_minutes", "cost_usd", "energy_kwh", "emissions_gco2eq",
        "carbon_intensity_mean", "renewable_percentage_mean", "power_w", "pue",
    ]
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("runs"), *[measures.mean_of(c).alias(c) for c in means])
    )


def _best(metric: str) -> Column:
    """Row with the lowest metric; equal metrics go to the smallest configuration key."""
    tie = [*fv.CONFIG, *ZONE]
    return F.min(F.when(F.col(metric).isNotNull(), F.struct(metric, *tie, *[c for c in OBJECTIVES if c != metric])))


def scenario_extremes(configurations: DataFrame) -> DataFrame:
    """Cheapest, greenest and fastest configuration of every scenario as structs."""
    return configurations.groupBy(*fv.SCENARIO).agg(
        F.count(F.lit(1)).alias("configurations"),
        _best("cost_usd").alias("cheapest"),
        _best("emissions_gco2eq").alias("greenest"),
        _best("runtime_minutes").alias("fastest"),
    )


def tradeoff(configurations: DataFrame) -> DataFrame:
    """Per scenario: the three extremes and what the greenest costs and saves against the cheapest."""
    cheap, green = F.col("cheapest"), F.col("greenest")

    def label(pick: str):
        return labels.config_label(*[F.col(f"{pick}.{c}") for c in fv.CONFIG])

    same = reduce(lambda a, b: a & b, [cheap[c].eqNullSafe(green[c]) for c in fv.CONFIG])
    saving = F.when(
        cheap.emissions_gco2eq > 0,
        (cheap.emissions_gco2eq - green.emissions_gco2eq) / cheap.emissions_gco2eq * 100.0,
    ).otherwise(F.lit(0.0))
    return scenario_extremes(configurations).select(
        *fv.SCENARIO,
        "configurations",
        label("cheapest").alias("cheapest"),
        F.round(cheap.cost_usd, 6).alias("cheapest_cost_usd"),
        F.round(cheap.emissions_gco2eq, 4).alias("cheapest_emissions_gco2eq"),
        label("greenest").alias("greenest"),
        F.round(green.cost_usd, 6).alias("greenest_cost_usd"),
        F.round(green.emissions_gco2eq, 4).alias("greenest_emissions_gco2eq"),
        label("fastest").alias("fastest"),
        F.round(F.col("fastest.runtime_minutes"), 4).alias("fastest_runtime_minutes"),
        same.alias("cheapest_is_greenest"),
        F.round(measures.regret_pct(green.cost_usd, cheap.cost_usd), 2).alias("cost_penalty_of_greenest_pct"),
        F.round(saving, 2).alias("carbon_saving_of_greenest_pct"),
    )


def regional_summary(configurations: DataFrame) -> DataFrame:
    """Means and total emissions by cloud, region and zone, greenest first."""
    means = {
        "mean_carbon_intensity": "carbon_intensity_mean",
        "mean_renewable_pct": "renewable_percentage_mean",
        "mean_runtime_minutes": "runtime_minutes",
        "mean_cost_usd": "cost_usd",
        "mean_energy_kwh": "energy_kwh",
        "mean_emissions_gco2eq": "emissions_gco2eq",
    }
    return (
        configurations.groupBy("cloud", "region", "electricity_zone")
        .agg(
            F.count(F.lit(1)).alias("configurations"),
            *[measures.mean_of(c, 6).alias(name) for name, c in means.items()],
            F.round(F.sum("emissions_gco2eq"), 6).alias("total_emissions_gco2eq"),
        )
        .orderBy("mean_emissions_gco2eq", "cloud", "region", "electricity_zone")
    )


def front_summary(flagged: DataFrame, tradeoffs: DataFrame) -> DataFrame:
    """One row of headline figures from the flagged configurations and the trade-off table."""
    sizes = flagged.groupBy(*fv.SCENARIO).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("on_pareto_front").alias("front")
    )
    joined = sizes.join(
        tradeoffs.select(*fv.SCENARIO, "cheapest_is_greenest", "cost_penalty_of_greenest_pct", "carbon_saving_of_greenest_pct"),
        fv.SCENARIO,
    )
    return joined.agg(
        F.sum("n").alias("configurations_evaluated"),
        F.count(F.lit(1)).alias("scenarios"),
        F.round(F.avg("front"), 2).alias("pareto_front_size_mean"),
        F.max("front").alias("pareto_front_size_max"),
        F.count_if("cheapest_is_greenest").alias("scenarios_where_cheapest_is_also_greenest"),
        F.round(F.avg("cost_penalty_of_greenest_pct"), 2).alias("mean_cost_penalty_of_greenest_pct"),
        F.round(F.avg("carbon_saving_of_greenest_pct"), 2).alias("mean_carbon_saving_of_greenest_pct"),
    )
