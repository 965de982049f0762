"""Result collection: compact the dropped result files, compare with the plan, list the retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import gaps
from runledger.session import stage
from runledger.sources import readers, sinks

NAMES = {
    "Region": "region", "VM_Size": "vm_size", "Nodes": "nodes", "Dataset_Size_MB": "dataset_size_mb",
    "Workload": "workload", "Run_Number": "run_number", "Timestamp": "timestamp", "Exit_Status": "exit_status",
}


def plan_shaped(results: DataFrame) -> DataFrame:
    return results.select(*[F.col(old).alias(new) for old, new in NAMES.items()])


def collect_results(
    results: DataFrame, campaigns: DataFrame, combo_status: DataFrame, success_wins: bool = False,
    retry_path: str | None = None,
) -> dict[str, DataFrame]:
    """passed, failed_or_missing and combos_to_retry; retry lists are written if a path is given."""
    compact = plan_shaped(readers.compact_snapshots(results))
    words = stage(gaps.audited_words(campaigns, compact, combo_status, success_wins), "audit")
    unfinished = gaps.word_runs(words, passed=False)
    if retry_path:
        sinks.write_retry_lists(unfinished, retry_path)
    return {
        "passed": gaps.word_runs(words, passed=True).select(*gaps.RUN_KEY),
        "failed_or_missing": unfinished.select(*gaps.RUN_KEY, "reason"),
        "combos_to_retry": gaps.retry_words(words),
    }
