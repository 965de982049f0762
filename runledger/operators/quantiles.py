"""Exact quantiles that never hold a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import stage

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row position below


_ACCURACY = 10_000
_MARGIN = 10 / _ACCURACY  # ten times the error the sketch admits


_CHUNK = 4096  # copies of a value that are unfolded at once


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], beside: dict[str, Column] | None = None) -> DataFrame:
    """Exact quantiles per key (null keys are a key): only rows between the bounds of the wanted ranks are sorted.

    A mergeable sketch gives two bounds around each quantile. One more scan
    counts the rows at, between and outside the bounds; of those between the
    bounds of a quantile, about 0.2 % of all, the values stay. The counts prove
    whether the wanted ranks lie inside; if any does not, all rows are sorted
    instead. A value that many rows share is itself a bound, so a rank that
    falls on it is known from the counts and its rows are never moved. beside:
    aggregates of the column `_v` (the values as doubles) that are taken in the
    scan of the sketch.
    """
    names = list(probabilities)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    levels = [min(max(p + side, 0.0), 1.0) for p in probabilities.values() for side in (-_MARGIN, _MARGIN)]
    aggregates = [c.alias(n) for n, c in (beside or {}).items()]
    first = stage(rows.groupBy(*keys).agg(F.percentile_approx("_v", levels, _ACCURACY).alias("_bounds"), *aggregates), "bounds")
    bounds, zones = ([F.col(f"{c}{j}") for j in range(len(levels))] for c in ("_bound", "_zone"))

    def up_to(bound: Column) -> Column:
        return F.size(F.filter("_bounds", lambda b: b < bound)) + F.size(F.filter("_bounds", lambda b: b <= bound))

    # A value's zone is how many bounds are below it and how many up to it, added: it rises with the value and tells a bound from what is on either side.
    every = [F.get("_bounds", F.lit(j)) for j in range(len(levels))]
    sketch = stage(first.select(*keys, *[b.alias(f"_bound{j}") for j, b in enumerate(every)], *[up_to(b).alias(f"_zone{j}") for j, b in enumerate(every)]), "sketch")

    def with_sketch(table: DataFrame, columns: list[Column]) -> DataFrame:
        if keys:
            return _null_safe(table, sketch.select(*keys, *columns), keys)
        return table.withColumn("_s", sketch.select(F.struct(*columns)).scalar()).select("*", "_s.*").drop("_s")

    def between(i: int, at: Column, limits: list[Column]) -> Column:
        return (at > limits[2 * i]) & (at < limits[2 * i + 1])

    v, at = F.col("_v"), F.col("_zone")
    near = reduce(lambda a, b: a | b, [between(i, v, bounds) for i in range(len(names))])
    zone = reduce(lambda a, b: a + b, [(b < v).cast("int") + (b <= v).cast("int") for b in bounds])
    placed = with_sketch(rows, bounds).select(*keys, zone.alias("_zone"), F.when(near, v).alias("_v"))
    cells = with_sketch(stage(placed.groupBy(*keys, "_zone", "_v").agg(F.count(F.lit(1)).alias("_n")), "cells"), zones)

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    counts = stage(
        cells.groupBy(*keys).agg(
            rows_where(F.lit(True)).alias("_total"),
            *[rows_where(at < zones[2 * i]).alias(f"_below{i}") for i in range(len(names))],
            *[rows_where(at == zones[2 * i]).alias(f"_low{i}") for i in range(len(names))],
            *[rows_where(between(i, at, zones)).alias(f"_inside{i}") for i in range(len(names))],
            *[rows_where((at == zones[2 * i + 1]) & (at > zones[2 * i])).alias(f"_high{i}") for i in range(len(names))],
        ),
        "counts",
    )
    h = {i: F.lit(float(probabilities[n])) * (F.col("_total") - 1) for i, n in enumerate(names)}
    opens = {i: F.col(f"_below{i}") + F.col(f"_low{i}") for i in h}  # the first rank between the bounds
    ends = {i: opens[i] + F.col(f"_inside{i}") for i in h}
    missed = [(F.floor(h[i]) < F.col(f"_below{i}")) | (F.ceil(h[i]) >= ends[i] + F.col(f"_high{i}")) for i in h]
    if not counts.filter(reduce(lambda a, b: a | b, missed)).isEmpty():
        return _beside(exact_quantiles(df, keys, value, probabilities), first, keys, beside)

    asked = stage(with_sketch(counts, bounds).select(*keys, F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("_i"), F.lit(side).alias("_side"), (h[i] - F.floor(h[i])).alias("_share"), (rank - opens[i]).cast("double").alias("_h"),
            F.when(rank < opens[i], bounds[2 * i]).when(rank >= ends[i], bounds[2 * i + 1]).alias("_q"),
        )
        for i in h for side, rank in enumerate((F.floor(h[i]), F.ceil(h[i])))
    ])).alias("_w")).select(*keys, "_w.*"), "asked")
    found = asked.dropna(subset=["_q"]).drop("_h")
    open_ranks = asked.filter(F.col("_q").isNull())
    if not open_ranks.isEmpty():
        inside = cells.dropna(subset=["_v"]).withColumn("_i", F.explode(F.filter(
            F.array(*[F.when(between(i, at, zones), F.lit(i)) for i in h]), lambda i: i.isNotNull(),
        )))
        chunks = inside.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_CHUNK).cast("long"))))
        copies = F.least(F.col("_n") - F.col("_from"), F.lit(_CHUNK)).cast("int")
        each = chunks.select(*keys, "_i", F.explode(F.array_repeat("_v", copies)).alias("_v"))
        wanted = open_ranks.select(*keys, "_i", "_side", "_share", "_h")
        found = found.unionByName(_values_at(each, [*keys, "_i"], wanted))

    def picked(i: int, side: int, column: str) -> Column:
        return F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col(column)))

    found = found.groupBy(*keys).agg(*[
        (picked(i, 0, "_q") + (picked(i, 1, "_q") - picked(i, 0, "_q")) * picked(i, 0, "_share")).alias(n) for i, n in enumerate(names)
    ])
    return _beside(found, first, keys, beside)


def _beside(found: DataFrame, first: DataFrame, keys: list[str], beside: dict[str, Column] | None) -> DataFrame:
    return _null_safe(found, first.select(*keys, *beside), keys) if beside and keys else found


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the keys, where a null key meets a null key; the left side's keys are kept."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per name in probabilities.

    The values are range-sorted over all tasks (the row id as last sort key
    splits even a single repeated value) and written once. Row counts per key
    and partition, a table of about one row per partition, then locate the
    wanted ranks, and only those rows are read again. percentile() would
    gather the distinct values of a hot key in one aggregation buffer.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    placed = _placed(values, keys)
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()]))
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).withColumn("_l", levels)
    wanted = totals.select(*keys, F.col("_l.name").alias("_name"), (F.col("_l.p") * (F.col("_total") - 1)).alias("_h"))
    found = _located(placed, keys, wanted)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probabilities])


def _values_at(values: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """wanted (keys and a fractional rank _h per row) with the interpolated value _q."""
    return _located(_placed(values, keys), keys, wanted)


def _placed(values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows range-sorted by keys and value and written with their partition and position."""
    order = [*keys, "_v"]
    row_id = F.monotonically_increasing_id()
    ranged = values.withColumn("_tie", row_id).repartitionByRange(*order, "_tie").sortWithinPartitions(*order)
    return stage(
        ranged.withColumn("_id", row_id).select(
            *order,
            F.shiftright("_id", _POSITION_BITS).alias("_part"),
            F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        ),
        "quantiles",
    )


def _located(placed: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The values at the two whole ranks around each wanted rank, interpolated."""
    blocks = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    tags = [c for c in wanted.columns if c not in keys and c != "_h"]
    key = F.struct(*[F.col(c) for c in keys]) if keys else F.lit(0)
    both = F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))
    asked = wanted.select(key.alias("_key"), *tags, "_h", both.alias("_rank"))
    held = blocks.select(key.alias("_bkey"), "_part", "_first", "_before", "_n")
    ranks = asked.join(held, F.col("_key").eqNullSafe(F.col("_bkey"))).filter("_rank >= _before and _rank < _before + _n")
    ranks = ranks.select(*tags, "_h", "_rank", "_part", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_pos"))
    picked = placed.join(ranks, ["_part", "_pos"])
    low = F.max(F.when(F.col("_rank") <= F.col("_h"), F.col("_v")))
    high = F.max(F.when(F.col("_rank") >= F.col("_h"), F.col("_v")))
    return (
        picked.groupBy(*keys, *tags, "_h")
        .agg(low.alias("_low"), high.alias("_high"))
        .select(*keys, *tags, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_h") - F.floor("_h"))).alias("_q"))
    )
