"""File sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import schemas
from runledger.operators.cleaning import newest_rows, require_columns

VM_RUN_KEY = ["Region", "VM_Size", "Nodes", "Dataset_Size_MB", "Workload", "Run_Number"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log: Parquet where the path ends in parquet, else CSV with a header."""
    if path.rstrip("/").lower().endswith("parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, schemas.EVENT)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RUNS)


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): lines with too many fields are rejected, short lines padded with nulls.

    Fields are counted on the line itself, outside quotes, because the CSV
    reader marks long and short lines alike. One record per line.
    """
    lines = spark.read.text(path)
    if header:
        lines = lines.filter(F.col("value") != ",".join(schema.names))
    unquoted = F.regexp_replace("value", '"[^"]*"', "")
    too_long = F.size(F.split(unquoted, ",")) > len(schema.fields)
    parsed = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "))
    rows = lines.filter(~too_long).select(parsed.alias("r")).select("r.*")
    return rows, lines.filter(too_long).select(F.col("value").alias("line"))


def read_result_drops(spark: SparkSession, folder: str, schema: T.StructType = schemas.VM_RESULTS) -> DataFrame:
    """All result files below a folder as one table, with the file each row came from.

    Unreadable files are skipped. Write merged results outside the folder, or
    the next read would take them in again.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("ignoreCorruptFiles", True)
        .csv(folder)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )


def compact_snapshots(rows: DataFrame) -> DataFrame:
    """Distinct runs of cumulative snapshot files, whatever file they were in."""
    data = [c for c in rows.columns if c != "source_file"]
    return rows.select(*data).dropDuplicates()


def latest_runs(rows: DataFrame) -> DataFrame:
    """One row per run key: the latest by timestamp, then by file name."""
    return newest_rows(rows, VM_RUN_KEY, ["Timestamp", "source_file"])


def read_lookup(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Lookup table whose header must name the required columns; power tables without source get 'unspecified'."""
    header = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f.dataType for f in schema.fields}
    table = spark.read.schema(T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header]))
    table = require_columns(table.option("header", True).csv(path), required)
    if "source" in declared and "source" not in header:
        table = table.withColumn("source", F.lit("unspecified"))
    return table
