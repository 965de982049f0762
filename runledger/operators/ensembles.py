"""Forests and boosted trees over few cells: all folds, targets and trees side by side in one Spark job.

A fit to a few thousand cells does not fill a cluster, and the folds of a
cross-validation or the left-out scenarios of an evaluation need dozens of them.
So they are one plan: Spark deals the cells to every (target, part of the trees,
part of the rows to score), each group grows its trees and scores its rows, and
an aggregation joins the parts. Nothing is fitted from the driver, and the plans
of several fits can be united before they run.

A group holds the cells of one fit (distinct feature vectors, GROUP_CELLS at
most; beyond that regression.fit trains with Spark ML over the whole cluster)
and GROUP_CELLS rows to score at most. Trees grow level by level from sums by
(node, feature, bin): every label is a split against the rest, every number's
distinct values (or quantile bins, if there are more) may be cut half-way
between two that the node has. A bootstrap draws every run of a cell, so its
weight is a Poisson number with the cell's runs as mean.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import fixed_values as fv

#: Cells that one group may hold, and trees of a forest that are grown together.
GROUP_CELLS, PART_TREES = 20_000, 5
#: Entries of a table of sums that are looked at together.
ENTRIES = 1 << 21


def _codes(column: np.ndarray, train: np.ndarray, numeric: bool, bins: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The bin of every row, and for numbers what each bin stands for."""
    values, codes = np.unique(column, return_inverse=True)
    if not numeric:
        return codes, None
    if len(values) > bins:
        edges = np.unique(np.quantile(column[train], np.linspace(0, 1, bins + 1)[1:-1]))
        codes = np.searchsorted(edges, column)
        values = np.bincount(codes, column, len(edges) + 1) / np.maximum(np.bincount(codes, minlength=len(edges) + 1), 1)
    return codes, values


def _best_splits(features: list, rows: np.ndarray, cell: np.ndarray, node: np.ndarray, weight: np.ndarray, weighted: np.ndarray, nodes: int, total: np.ndarray, summed: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node the gain, the feature, the bin and (for numbers) the cut of its best split."""
    gain, feature, at, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    here = np.where(total > 0, summed**2 / np.maximum(total, 1e-300), 0.0)
    for number, (codes, values) in enumerate(features):
        bins = int(codes.max()) + 1
        if bins < 2:
            continue
        key = node * bins + codes[cell[rows]]
        w = np.bincount(key, weight[rows], nodes * bins).reshape(nodes, bins)
        s = np.bincount(key, weighted[rows], nodes * bins).reshape(nodes, bins)
        left_w, left_s = (w, s) if values is None else (np.cumsum(w, 1), np.cumsum(s, 1))
        right_w, right_s = total[:, None] - left_w, summed[:, None] - left_s
        sound = (left_w > 1e-9) & (right_w > 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = np.where(sound, left_s**2 / left_w + right_s**2 / right_w, -np.inf) - here[:, None]
        best = gains.argmax(1)
        found = gains[np.arange(nodes), best]
        better = np.flatnonzero(found > gain * (1 + 1e-12))
        gain[better], feature[better], at[better] = found[better], number, best[better]
        if values is not None and len(better):
            # The next bin that the node has bounds the cut from above.
            after = np.where((w[better] > 1e-9) & (np.arange(bins) > best[better][:, None]), np.arange(bins), bins - 1).min(1)
            cut[better] = (values[best[better]] + values[after]) / 2
    return gain, feature, at, cut


def grow(features: list, cell: np.ndarray, tree: np.ndarray, weight: np.ndarray, target: np.ndarray, depth: int) -> np.ndarray:
    """What the tree of each row says for its cell. Rows of weight 0 only follow the splits of the others."""
    says, weighted = np.zeros(len(cell)), weight * target
    rows, node = np.arange(len(cell)), tree.astype(np.int64)
    for level in range(depth + 1):
        # Nodes in the order of their rows, so that a part of the nodes is a slice of the rows.
        _, node = np.unique(node, return_inverse=True)
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        nodes = int(node[-1]) + 1
        total, summed = np.bincount(node, weight[rows], nodes), np.bincount(node, weighted[rows], nodes)
        squares = np.bincount(node, weighted[rows] * target[rows], nodes)
        says[rows] = (summed / np.maximum(total, 1e-300))[node]
        if level == depth:
            break
        step = max(1, ENTRIES // max(int(codes.max()) + 1 for codes, _ in features))
        splits = []
        for first in range(0, nodes, step):
            last = min(first + step, nodes)
            part = slice(*np.searchsorted(node, [first, last]))
            splits.append(_best_splits(features, rows[part], cell, node[part] - first, weight, weighted, last - first, total[first:last], summed[first:last]))
        gain, feature, at, cut = (np.concatenate(x) for x in zip(*splits, strict=True))
        # A pure node gains nothing but rounding.
        goes_on = (gain > 1e-11 * np.maximum(squares, 1e-300))[node]
        rows, node = rows[goes_on], node[goes_on]
        if not len(rows):
            break
        left = np.zeros(len(rows), bool)
        for number, (codes, values) in enumerate(features):
            mine = np.flatnonzero(feature[node] == number)
            code = codes[cell[rows[mine]]]
            left[mine] = code == at[node[mine]] if values is None else values[code] <= cut[node[mine]]
        node = 2 * node + left
    return says


def _forest(features: list, weight: np.ndarray, target: np.ndarray, scored: np.ndarray, trees: range, settings: dict) -> np.ndarray:
    """The sum of what the trees say for the scored rows."""
    cells, numbers, weights = [], [], []
    train = np.flatnonzero(weight > 0)
    for number in trees:
        drawn = np.zeros(len(weight))
        drawn[train] = np.random.default_rng([settings["seed"], number]).poisson(weight[train])
        used = np.flatnonzero((drawn > 0) | scored)
        cells.append(used)
        numbers.append(np.full(len(used), number))
        weights.append(drawn[used])
    cell = np.concatenate(cells)
    says = grow(features, cell, np.concatenate(numbers), np.concatenate(weights), target[cell], settings["maxDepth"])
    return np.bincount(cell, says, len(weight))[scored]


def _boosted(features: list, weight: np.ndarray, target: np.ndarray, scored: np.ndarray, settings: dict) -> np.ndarray:
    """From the mean, each tree adds a share of what it says of the rest."""
    cell, tree = np.arange(len(weight)), np.zeros(len(weight), np.int64)
    says = np.full(len(weight), np.average(target, weights=weight))
    for _ in range(settings["maxIter"]):
        says += settings["stepSize"] * grow(features, cell, tree, weight, target - says, settings["maxDepth"])
    return says[scored]


def _scorer(model_type: str, settings: dict, out: T.StructType) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(out)
        part = key[1].as_py()
        weight = table.column("weight").to_numpy()
        scored = table.column("scored").to_numpy(zero_copy_only=False).astype(bool)
        target = np.nan_to_num(table.column("target_value").to_numpy(zero_copy_only=False).astype(float))
        if not scored.any() or not (weight > 0).any():
            return fields.empty_table()
        features = []
        for name in fv.FEATURES:
            numeric = name in fv.NUMERIC
            column = table.column(name).to_numpy(zero_copy_only=False)
            features.append(_codes(column.astype(float) if numeric else column.astype(str), weight > 0, numeric, settings["maxBins"]))
        # The draws follow the order of the cells, so that must not depend on the shuffle.
        order = np.lexsort([scored, *(codes for codes, _ in features)])
        features = [(codes[order], values) for codes, values in features]
        weight, target, scored = weight[order], target[order], scored[order]
        if model_type == "random_forest":
            trees = range(part * PART_TREES, min((part + 1) * PART_TREES, settings["numTrees"]))
            says, count = _forest(features, weight, target, scored, trees, settings), len(trees)
        else:
            says, count = _boosted(features, weight, target, scored, settings), 1
        rows = table.take(pa.array(order[scored])).select(fv.FEATURES)
        added = [pa.array([key[0].as_py()] * len(says)), pa.array(says), pa.array(np.full(len(says), count))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip([*rows.columns, *added], fields, strict=True)], schema=fields)

    return run


def scores(cells: DataFrame, features: DataFrame, model_type: str, settings: dict) -> DataFrame:
    """The distinct feature vectors of `features` with predicted_runtime_minutes and predicted_cost_usd, from a model of the cells.

    cells: features, weight (runs) and mean targets. One plan; nothing runs here
    but the count of the vectors to score.
    """
    wanted = features.select(*fv.FEATURES).distinct()
    chunks = max(1, -(-wanted.count() // GROUP_CELLS))
    parts = -(-settings["numTrees"] // PART_TREES) if model_type == "random_forest" else 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    training = cells.select(*fv.FEATURES, "weight", *fv.TARGETS, F.lit(False).alias("scored"), every(chunks).alias("chunk"))
    asked = wanted.select(*fv.FEATURES, F.lit(0.0).alias("weight"), *(F.lit(0.0).alias(t) for t in fv.TARGETS), F.lit(True).alias("scored"), F.pmod(F.xxhash64(*fv.FEATURES), F.lit(chunks)).cast("int").alias("chunk"))
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("target_value")) for t in fv.TARGETS))).alias("_t")
    rows = training.unionByName(asked).select("*", pairs).select(*fv.FEATURES, "weight", "scored", "chunk", "_t.*").select("*", every(parts).alias("part"))
    out = T.StructType([*(T.StructField(c, wanted.schema[c].dataType) for c in fv.FEATURES), *T.StructType.fromDDL("target string, says double, trees long").fields])
    said = rows.groupBy("target", "part", "chunk").applyInArrow(_scorer(model_type, settings, out), out)
    mean = lambda t: F.sum(F.when(F.col("target") == t, F.col("says"))) / F.sum(F.when(F.col("target") == t, F.col("trees")))
    return said.groupBy(*fv.FEATURES).agg(*(mean(t).alias(f"predicted_{t}") for t in fv.TARGETS))
