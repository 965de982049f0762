"""Planned against actual runs: gaps, retries, completed and failed experiments, quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels

COMBO = ["region", "vm_size", "nodes"]
CELL = [*COMBO, "dataset_size_mb", "workload"]
RUN_KEY = [*CELL, "run_number"]
#: Runs of a word: a long with a bit for each run number.
WORD = 64


def expected_runs(campaigns: DataFrame) -> DataFrame:
    """Every run a campaign plans.

    A campaign row holds the lists regions, vm_sizes, node_counts,
    dataset_sizes, workloads and the number of repetitions. The lists are
    exploded one by one; the combinations are spread over the tasks before the
    inner lists multiply them.
    """
    # A sequence from 1 to 0 would count down.
    combos = (
        campaigns.filter("repetitions >= 1").withColumn("region", F.explode("regions"))
        .withColumn("vm_size", F.explode("vm_sizes"))
        .withColumn("nodes", F.explode("node_counts"))
        .repartition(*COMBO)
    )
    return (
        combos.withColumn("dataset_size_mb", F.explode("dataset_sizes"))
        .withColumn("workload", F.explode("workloads"))
        .withColumn("run_number", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int"))))
        .select(*RUN_KEY)
        .distinct()
    )


def last_status(results: DataFrame, success_wins: bool = False) -> DataFrame:
    """Status of every run key: the latest row's, or success if any row succeeded."""
    order = F.struct("timestamp", "exit_status")
    if success_wins:
        order = F.struct((F.col("exit_status") == "SUCCESS").alias("ok"), "timestamp", "exit_status")
    return results.groupBy(*RUN_KEY).agg(F.max(order).exit_status.alias("status"))


def audited_runs(expected: DataFrame, results: DataFrame, combo_status: DataFrame, success_wins: bool = False) -> DataFrame:
    """Expected runs with passed, reason and retry.

    The reason is the note of a skipped or failed combination, else a failed
    run, else a missing one. Runs of skipped combinations are not retried.
    """
    return _verdict(expected.join(last_status(results, success_wins), RUN_KEY, "left").join(_noted(combo_status), COMBO, "left"))


def _noted(combo_status: DataFrame) -> DataFrame:
    return (
        combo_status.filter(F.col("status").isin("SKIPPED", "FAILED"))
        .groupBy(*COMBO)
        .agg(F.max(F.concat("status", F.lit(": "), F.coalesce("note", F.lit("")))).alias("_note"))
    )


def _skipped() -> Column:
    return F.coalesce(F.startswith("_note", F.lit("SKIPPED")), F.lit(False))


def _verdict(runs: DataFrame) -> DataFrame:
    passed = F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    reason = F.coalesce(
        F.col("_note"),
        F.when(F.col("status") == "FAILED", F.lit("run FAILED")),
        F.lit("never ran / missing"),
    )
    return runs.select(
        *RUN_KEY,
        passed.alias("passed"),
        F.when(~passed, reason).alias("reason"),
        (~passed & ~_skipped()).alias("retry"),
    )


def expected_words(campaigns: DataFrame) -> DataFrame:
    """The planned runs as words: CELL, word and wanted, whose bit b is run number 64 x word + b + 1.

    Runs that several campaigns plan are planned once. A cell has a row for
    every 64 runs, so a long campaign is no long group.
    """
    cells = (
        campaigns.withColumn("region", F.explode("regions"))
        .withColumn("vm_size", F.explode("vm_sizes"))
        .withColumn("nodes", F.explode("node_counts"))
        .withColumn("dataset_size_mb", F.explode("dataset_sizes"))
        .withColumn("workload", F.explode("workloads"))
        .groupBy(*CELL).agg(F.max(F.col("repetitions").cast("int")).alias("_runs"))
    )
    words = cells.filter("_runs > 0").withColumn("word", F.explode(F.sequence(F.lit(0), F.expr(f"(_runs - 1) div {WORD}").cast("int"))))
    runs = F.col("_runs") - WORD * F.col("word")
    return words.select(*CELL, "word", F.when(runs >= WORD, F.lit(-1).cast("long")).otherwise(F.expr(f"shiftleft(1L, cast(_runs - {WORD} * word as int)) - 1")).alias("wanted"))


def seen_words(results: DataFrame, success_wins: bool = False) -> DataFrame:
    """Runs by their last status as words: CELL, word, passed and failed."""
    bit = F.expr(f"shiftleft(1L, cast((run_number - 1) % {WORD} as int))")
    word = F.expr(f"(run_number - 1) div {WORD}").cast("int").alias("word")
    runs = last_status(results.filter("run_number >= 1"), success_wins)
    return runs.groupBy(*CELL, word).agg(*[F.bit_or(F.when(F.col("status") == s, bit)).alias(n) for s, n in (("SUCCESS", "passed"), ("FAILED", "failed"))])


def audited_words(campaigns: DataFrame, results: DataFrame, combo_status: DataFrame, success_wins: bool = False) -> DataFrame:
    """CELL, word, wanted, passed, failed and the note of a skipped or failed combination.

    Planned and seen runs meet as words, a row for 64 runs; runs become rows
    only where they are put out (word_runs).
    """
    nothing = F.lit(0).cast("long")
    return (
        expected_words(campaigns).join(seen_words(results, success_wins), [*CELL, "word"], "left").join(_noted(combo_status), COMBO, "left")
        .select(*CELL, "word", "wanted", F.coalesce("passed", nothing).bitwiseAND(F.col("wanted")).alias("passed"), F.coalesce("failed", nothing).alias("failed"), "_note")
    )


def word_runs(words: DataFrame, passed: bool | None = None) -> DataFrame:
    """The runs of audited words with passed, reason and retry, as of audited_runs; only those that passed, or did not, if asked for."""
    wanted = F.col("wanted") if passed is None else F.col("passed") if passed else F.col("wanted").bitwiseAND(F.bitwise_not("passed"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("_bits", b) == 1)
    runs = words.withColumn("_bits", wanted).withColumn("_bit", F.explode(bits))
    status = F.when(F.getbit("passed", F.col("_bit")) == 1, "SUCCESS").when(F.getbit("failed", F.col("_bit")) == 1, "FAILED")
    return _verdict(runs.withColumns({"run_number": F.col("word") * WORD + F.col("_bit") + 1, "status": status}))


def retry_words(words: DataFrame) -> DataFrame:
    """retry_index of audited words, by counting bits."""
    open_runs = F.sum(F.bit_count(F.col("wanted").bitwiseAND(F.bitwise_not("passed")))).alias("runs")
    return _with_list_path(words.filter(~_skipped()).groupBy(*COMBO).agg(open_runs).filter("runs > 0"))


def retry_index(audited: DataFrame) -> DataFrame:
    """Combinations with runs to retry and where their list is written."""
    return _with_list_path(audited.filter("retry").groupBy(*COMBO).agg(F.count(F.lit(1)).alias("runs")))


def _with_list_path(combos: DataFrame) -> DataFrame:
    return combos.withColumn("retry_list_path", F.format_string("region=%s/vm_size=%s/nodes=%d", "region", "vm_size", "nodes"))


def pending_plan(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned runs without a recorded run; the region of a recorded run is read from its source."""
    done = runs.select(
        F.regexp_extract("source", "aws-emr:([^:]+):", 1).alias("region"),
        F.col("dataset_size_mb").cast("double").alias("dataset_size_mb"),
        "workload_type",
        "machine_type",
        F.col("nodes").cast("int").alias("nodes"),
    ).distinct()
    keys = ["region", "dataset_size_mb", "workload_type", "machine_type", "nodes"]
    return plan.join(done, keys, "left_anti")


def failed_experiments(failed: DataFrame) -> DataFrame:
    """Distinct failed experiments with unified size and node texts, in order of first failure."""
    size = F.col("dataset_size_mb").cast("double")
    size_text = F.when(size == F.floor(size), size.cast("bigint").cast("string")).otherwise(size.cast("string"))
    return (
        failed.groupBy(
            F.trim("region").alias("region"),
            size_text.alias("dataset_size_mb"),
            F.trim("workload_type").alias("workload_type"),
            F.trim("instance_type").alias("instance_type"),
            F.col("nodes").cast("double").cast("int").alias("nodes"),
        )
        .agg(F.min("timestamp_utc").alias("first_failure"))
        .orderBy("first_failure", "region", "dataset_size_mb", "workload_type", "instance_type", "nodes")
    )


def vm_specs(spark) -> DataFrame:
    return spark.createDataFrame(fv.VM_SIZES, "vm_size string, vcpus int, ram_gb int, family string")


def with_vm_specs(df: DataFrame, specs: DataFrame) -> DataFrame:
    """vCPUs, memory, family and short codes of every VM size; unknown sizes get 0, 0 and 'unknown'."""
    return df.join(specs, "vm_size", "left").withColumns({
        "vcpus": F.coalesce("vcpus", F.lit(0)),
        "ram_gb": F.coalesce("ram_gb", F.lit(0)),
        "family": F.coalesce("family", F.lit("unknown")),
        "size_code": labels.size_code(F.col("vm_size")),
        "region_code": labels.region_abbreviation(F.col("region")),
    })


def quota_check(combos: DataFrame, specs: DataFrame, caps: DataFrame) -> DataFrame:
    """Whether a combination fits the vCPU cap of its region and family (no cap listed means 0)."""
    needed, cap = F.col("vcpus") * F.col("nodes"), F.coalesce("vcpu_cap", F.lit(0))
    note = F.format_string("needs %d vCPU > %s cap %d", needed, "family", cap)
    return with_vm_specs(combos, specs).join(caps, ["region", "family"], "left").select(
        *combos.columns,
        "family",
        needed.alias("needed_vcpus"),
        cap.alias("vcpu_cap"),
        (needed <= cap).alias("fits"),
        F.when(needed > cap, F.lit("SKIPPED")).alias("status"),
        F.when(needed > cap, note).alias("note"),
    )
