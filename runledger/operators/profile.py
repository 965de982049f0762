"""Descriptive tables of a run dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import measures
from runledger.operators.quantiles import quantiles
from runledger.session import stage

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max, one row per column.

    All columns share one scan: they become (column, value) rows that are
    aggregated in the map tasks, the moments together with the bounds of the
    quartiles, which come from the rows around them.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    long = long.dropna(subset=["value"])
    moments = {"count": F.count("_v"), "mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v")}
    found = quantiles(long, ["column"], "value", QUARTILES, moments)
    return found.select("column", "count", "mean", "std", "min", "max", *QUARTILES)


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (the smallest of equals) and its frequency, one row per column."""
    long = df.select(*columns).unpivot([], columns, "column", "value").dropna(subset=["value"])
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("value").alias("top")))
    return (
        counts.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
        .select("column", "count", "unique", "b.top", (-F.col("b.less")).alias("freq"))
    )


def grouped_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_size_mb", "workload_type", "machine_type", "nodes").agg(
        measures.mean_of("runtime_minutes").alias("runtime_mean"),
        measures.mean_of("cost_usd").alias("cost_mean"),
        F.count("runtime_minutes").alias("runs"),
    )


_LABELS = {"dataset_size_mb": "dataset_sizes_mb", "workload_type": "workloads", "machine_type": "machine_types", "nodes": "node_counts"}


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows): the distinct labels as rows, aggregated in the map tasks."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.dropna(subset=["value"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def dataset_summary(df: DataFrame, listed: int | None = None) -> DataFrame:
    """One row: row count, all distinct labels in order and how many they are, and the range of runtime and cost.

    The labels are counted as rows first, so a list is made of distinct values
    alone, and no list goes through the driver. A caller that wants a short
    document says how many labels may be `listed`: a column with more has null
    for its list, and label_counts has its labels as rows.
    """
    counts = stage(label_counts(df, [*_LABELS]), "labels")
    numbers = counts.groupBy().agg(*[F.count_if(F.col("column") == c).alias(f"n_{n}") for c, n in _LABELS.items()])
    few = counts
    if listed is not None:
        sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        few = counts.join(sizes.filter(F.col("distinct") <= listed), "column", "left_semi")
    lists = few.groupBy().agg(*[
        F.sort_array(F.collect_list(F.when(F.col("column") == c, F.col("value").cast(df.schema[c].dataType)))).alias(n) for c, n in _LABELS.items()
    ])

    def span(column: str, digits: int):
        return F.struct(
            F.round(F.min(column), digits).alias("min"), F.round(F.avg(column), digits).alias("mean"),
            F.round(F.max(column), digits).alias("max"),
        ).alias(column)

    whole = df.agg(F.count(F.lit(1)).alias("rows"), span("runtime_minutes", 4), span("cost_usd", 6))
    # Each part is one row; united and folded into one, they meet in a task.
    parts = whole.unionByName(lists, allowMissingColumns=True).unionByName(numbers, allowMissingColumns=True)
    names = ["rows", *_LABELS.values(), *numbers.columns, "runtime_minutes", "cost_usd"]
    row = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    if listed is None:
        return row
    return row.withColumns({n: F.when(F.col(f"n_{n}") <= listed, F.col(n)) for n in _LABELS.values()})


def mean_cost_by_workload(df: DataFrame) -> DataFrame:
    return df.groupBy("workload_type", "machine_type").agg(measures.mean_of("cost_usd").alias("cost_usd"))


def runtime_box(df: DataFrame) -> DataFrame:
    """Least, quartiles and greatest runtime by workload and machine."""
    return quantiles(df, ["workload_type", "machine_type"], "runtime_minutes", {"least": 0.0, **QUARTILES, "greatest": 1.0})


def runtime_by_size(df: DataFrame) -> DataFrame:
    """Mean runtime by dataset size for every workload, machine and node count."""
    return (
        df.groupBy("workload_type", "machine_type", "nodes", "dataset_size_mb")
        .agg(measures.mean_of("runtime_minutes").alias("runtime_minutes"))
        .orderBy("workload_type", "machine_type", "nodes", "dataset_size_mb")
    )


def scatter_rows(df: DataFrame) -> DataFrame:
    return df.select("runtime_minutes", "cost_usd", "workload_type", "machine_type", "dataset_size_mb", "nodes")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def missing_reference(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value, as one row."""
    return df.agg(F.count_if(F.col(column).isNull()).alias("missing"))


EDA_REQUIRED = ["dataset_size_mb", "workload_type", "machine_type", "nodes", *fv.TARGETS]
