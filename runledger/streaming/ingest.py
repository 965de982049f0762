"""Incremental ingest of result files and enrichment of finished runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger import schemas
from runledger.functions import labels
from runledger.operators import enrich
from runledger.sources.readers import VM_RUN_KEY


def result_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, done: str = "off") -> DataFrame:
    """Result rows of every CSV file, plain or compressed by gzip, that lands below a folder.

    done: what becomes of the files of a finished batch (cleanSource). "delete"
    removes them when the next batch begins, so that a landing zone that only
    feeds the stream holds the last two batches, not all there ever were.
    """
    reader = spark.readStream.schema(schemas.VM_RESULTS).option("header", True).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", "*.{csv,csv.gz}").option("cleanSource", done)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


RUN = [*VM_RUN_KEY, "Timestamp"]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ingest(results: DataFrame, table: str, checkpoint: str, files: int = 4) -> StreamingQuery:
    """Append each new run once to a Parquet table, though snapshots repeat it: all files present, then stop.

    The runs seen so far are the stream's state, kept by run without a limit in
    time: no run is ever too late, and a batch touches the state of its own runs
    only. The stored table is never read, whatever its size. Of rows that agree
    in RUN the first to arrive is kept (of one batch, any). A batch is written as
    `files` files below its own folder and overwrites it, so a batch repeated
    after a failure leaves no second copy. A batch's shuffle files are removed
    with its end, not with the session's.

    On a cluster keep the state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.repartition(files).write.mode("overwrite").parquet(f"{table}/batch={number}")

    new = results.dropDuplicates(RUN)
    settings = results.sparkSession.conf
    kept = settings.get(CLEANUP, "false")
    settings.set(CLEANUP, True)
    try:  # a stream takes a copy of the settings when it starts
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        settings.set(CLEANUP, kept)


def enrich_runs(lowest: DataFrame, features: DataFrame, model: str = "on-demand") -> Callable[[DataFrame], DataFrame]:
    """Function adding price, cost, zone and carbon features to raw VM rows.

    Both lookups are static tables read from files, joined by broadcast while
    they are below the session's threshold.
    """

    def run(raw: DataFrame) -> DataFrame:
        runs = raw.select(
            F.lit("azure").alias("cloud"), F.col("Region").alias("region"), F.col("VM_Size").alias("machine_type"),
            F.col("Nodes").alias("nodes"), F.col("Dataset_Size_MB").alias("dataset_size_mb"),
            labels.workload_label("Workload").alias("workload_type"), F.col("Run_Number").alias("run_number"),
            F.col("Timestamp").alias("finished_at"), F.col("Runtime_Minutes").alias("runtime_minutes"), F.col("Exit_Status").alias("exit_status"),
            F.lit(model).alias("pricing_model"),
        )
        priced = enrich.priced_runs(runs, lowest, "azure").drop("region_key")
        keyed = enrich.with_join_keys(priced)
        return keyed.join(features, enrich.KEYS, "left").drop(*enrich.KEYS)

    return run


def split_sinks(results: DataFrame, enriched: Callable[[DataFrame], DataFrame], table: str, failed_table: str, checkpoint: str) -> StreamingQuery:
    """Finished runs to one table and failed or unpriced ones, with the stage, to another.

    Every batch overwrites its own batch=N folder, so a batch repeated after a
    failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = enriched(batch).persist()
        try:
            succeeded = F.coalesce(F.col("exit_status") == "SUCCESS", F.lit(False))
            priced = F.col("cost_usd").isNotNull()
            stage = F.when(~succeeded, F.lit("step")).otherwise(F.lit("cost"))
            rows.filter(succeeded & priced).write.mode("overwrite").parquet(f"{table}/batch={number}")
            rows.filter(~(succeeded & priced)).withColumn("stage", stage).write.mode("overwrite").parquet(f"{failed_table}/batch={number}")
        finally:
            rows.unpersist()

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
