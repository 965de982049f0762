"""Sinks: tables, partitioned layouts, reports and job metrics."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import schemas



def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_region(events: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Region-partitioned Parquet in timestamp order, read back.

    Range-splitting on (region, timestamp) gives a large region many writing
    tasks; hashing by region alone would give it one. Every file holds one
    region and a span of time, so min/max statistics prune time filters.
    """
    keys = ["region", "timestamp"]
    ranged = events.repartitionByRange(files, *keys) if files else events.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("region").parquet(path)
    types = {f.name: f.dataType for f in events.schema.fields}
    names = [c for c in events.columns if c != "region"] + ["region"]
    schema = T.StructType([T.StructField(c, types[c]) for c in names])
    return events.sparkSession.read.schema(schema).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports: one task streams all rows, after the plan has run in parallel.

    A table that isn't a report goes to write_csv, which writes a file a task.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def drop_names(df: DataFrame, by: str = "source_file") -> list:
    """The few values of `by`, in order.

    One is looked up after the other, and a look-up ends at the first row with
    another value: where `by` is a constant of each part of a union, as in a
    list of snapshots, no part is read to its end.
    """
    names = []
    while row := df.select(by).filter(reduce(lambda rest, name: rest & ~F.col(by).eqNullSafe(F.lit(name)), names, F.lit(True))).first():
        names.append(row[by])
    return sorted(names, key=lambda name: (name is not None, name))


#: Rows of a compressed CSV file, which one task has to read as a whole.
FILE_ROWS = 250_000
#: CSV options for gzip at its fastest level: a fifth of the bytes for little more time than plain text.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_ROWS}


def write_drop(df: DataFrame, folder: str, name: object, by: str = "source_file", compressed: bool = False) -> None:
    """The rows of one value of `by` as CSV files with a header, by gzip if wanted, in the sub-folder drop=<value>."""
    rows = df.filter(F.col(by).eqNullSafe(F.lit(name))).drop(by)
    rows.write.option("header", True).options(**(GZIP if compressed else {})).csv(f"{folder}/drop={name}")


def write_drops(df: DataFrame, folder: str, by: str = "source_file") -> None:
    """CSV files with a header, one sub-folder drop=<value> for each of the few values of `by`.

    One value is written after the other: with partitionBy every task would
    first sort all its rows, which spills as the tasks grow.
    """
    for name in drop_names(df, by):
        write_drop(df, folder, name, by)


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append with a fixed column order; the columns and types must match the schema."""
    ordered = df.select(*schema.names)
    wrong = [f.name for f, have in zip(schema.fields, ordered.schema.fields) if f.dataType != have.dataType]
    if wrong:
        raise ValueError(f"columns of another type than the table: {', '.join(wrong)}")
    ordered.write.mode("append").parquet(path)


def write_records(df: DataFrame, path: str, form: str = "json", by: list[str] | None = None) -> None:
    """CSV with header or JSON lines, optionally one folder per value of the by columns."""
    writer = df.write.mode("overwrite").partitionBy(*(by or []))
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One-row summary document as JSON."""
    df.write.mode("overwrite").json(path)


def write_retry_lists(audited: DataFrame, path: str) -> None:
    """The runs to repeat, one file per region, size and node count (a combination plans few runs)."""
    runs = audited.filter("retry").select(
        "region", "vm_size", "nodes",
        F.col("dataset_size_mb").alias("Dataset_Size_MB"), F.col("workload").alias("Workload"),
        F.col("run_number").alias("Run_Number"),
    )
    combo = ["region", "vm_size", "nodes"]
    runs.repartition(*combo).write.mode("overwrite").partitionBy(*combo).option("header", True).csv(path)


def write_measured(df: DataFrame, path: str, workload: str, input_path: str, metrics_path: str | None = None) -> DataFrame:
    """Write df as Parquet and return its job metric row.

    The row count is observed while writing, so no second run of the plan is needed.
    """
    started = time.monotonic()
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    seconds = round(time.monotonic() - started, 3)
    row = df.sparkSession.createDataFrame([(workload, input_path, path, seen.get["rows"], seconds)], schemas.METRIC)
    if metrics_path:
        row.write.mode("append").json(metrics_path)
    return row
