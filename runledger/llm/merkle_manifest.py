"""A Merkle manifest of a table, by time-forward processing.

Every row is a leaf. The rows of a group are a run of leaves in the order of
their ids; node after node, `fanout` of them become a parent, up to the group's
subroot. The subroots, in the order of their groups, likewise give the root.

Nodes are labelled by (group, level, number), so that children come before their
parents. A digest is a message to the parent's label, and a priority queue hands
them out in the order of labels. Over the whole tree that queue is external: the
messages between two bands of `BAND` levels are dealt by a sorted exchange,
which keeps on disk what doesn't fit in memory. Inside a band a task has one
subtree, whose messages wait in a heap. Going back, labels descend: each node
passes the proof it got (the siblings from its place up) with its own siblings
to its children. The rows of a table never meet in one task, whatever the size
of a group.

Leaves are numbered by one range sort on (group, id, digest) and the counts of
the sorted parts. Groups are counted in the same way, so that many of them, even
one for each row, are a tree of their own like any other.

Defined cases: null fields count as `-`; a null group is a group, the first; null
ids come first; equal ids follow their digests, and rows alike in all fields are
leaves each. A lone leaf is its subroot, a lone subroot the root. An empty table
has no rows and no root. Texts are hashed whole. Columns that aren't named are
not part of the manifest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import arrow_schema, schema
from runledger.session import stage

#: Children of a node, and levels that a task works through at once (a subtree of FANOUT ** BAND nodes at most).
FANOUT, BAND = 2, 6
#: For each level from a node up: what stands before and behind it in its run, digests joined.
PROOF = "array<struct<before:string,behind:string>>"
#: The columns of a node; size is the number of leaves of its tree.
NODE = ["tree", "number", "digest", "size"]


def combined(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the joined inputs; digests are taken as their hex text."""
    return F.sha2(F.concat(*(c.cast("binary") for c in inputs)), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that joined fields can't be confused; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    return combined(*(field(F.col(c) if isinstance(c, str) else c) for c in columns))


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to. Native, for whoever verifies a row."""
    return F.aggregate(proof, node, lambda digest, step: combined(step["before"], digest, step["behind"]))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(size: int, fanout: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fanout), levels + 1
    return levels


def sweep_up(lowest: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The digests of a subtree, level by level: a heap delivers each child's digest to its parent's label."""
    found: list[list[str]] = [lowest, *([] for _ in range(levels))]
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, number: int, digest: str) -> None:
        if level < levels:
            heapq.heappush(queue, (level + 1, number // fanout, number, digest))

    for number, digest in enumerate(lowest):
        send(0, number, digest)
    while queue:
        level, number = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, number):
            children.append(heapq.heappop(queue)[3])
        digest = _digest("".join(children))
        found[level].append(digest)
        send(level, number, digest)
    return found


def sweep_down(found: list[list[str]], proof: list[tuple[str, str]], fanout: int) -> Iterator[list[tuple[str, str]]]:
    """The proofs of a subtree's lowest nodes, in order, from its top's: a heap of descending labels delivers what stands above."""
    queue = [(1 - len(found), 0, (None, proof))]
    while queue:
        level, number, above = heapq.heappop(queue)
        if level == 0:
            own = []
            while above[0] is not None:
                own.append(above[0])
                above = above[1]
            yield own + above[1]
            continue
        run = found[-level - 1][number * fanout : (number + 1) * fanout]
        for i in range(len(run)):
            heapq.heappush(queue, (level + 1, number * fanout + i, (("".join(run[:i]), "".join(run[i + 1 :])), above)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block) in turn, from rows that are sorted by them. A block is small."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        at = 0
        for here, rows in groupby(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            n = len(list(rows))
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield pa.Table.from_batches(held)


def _dealt(nodes: DataFrame, fanout: int, band: int) -> DataFrame:
    """Whole blocks in a task, in order: the exchange sorts outside of memory where it has to."""
    keyed = nodes if "block" in nodes.columns else nodes.withColumn("block", F.floor(F.col("number") / F.lit(fanout**band)))
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "number")


def climb(nodes: DataFrame, fanout: int = FANOUT, band: int = BAND) -> tuple[DataFrame, list[DataFrame]]:
    """The top node of each tree, and the lowest nodes of each band; the first are the leaves."""
    nodes, bands = stage(nodes, "leaves"), []
    out = schema(nodes, ["tree"], "number long, digest string, size long")
    fields = arrow_schema(out)
    largest = nodes.agg(F.max("size")).first()[0] or 0
    for base in range(0, max(height(largest, fanout), 1), band):

        def up(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            rows = []
            for block in _blocks(batches):
                tree, number, size = (block.column(c)[0].as_py() for c in ("tree", "block", "size"))
                levels = max(min(band, height(size, fanout) - base), 0)
                rows.append((tree, number, sweep_up(block.column("digest").to_pylist(), levels, fanout)[-1][0], size))
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        bands.append(nodes)
        nodes = stage(_dealt(nodes.select(*NODE), fanout, band).mapInArrow(up, out), "nodes")
    return nodes, bands


def _proofs(column: list[list[tuple[str, str]]], kind: pa.DataType) -> pa.Array:
    offsets = [0]
    for proof in column:
        offsets.append(offsets[-1] + len(proof))
    steps = [pa.array([step[i] for proof in column for step in proof], pa.string()) for i in range(2)]
    fields = [kind.value_type.field(i) for i in range(2)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(steps, fields=fields), type=kind)


def descend(bands: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, band: int = BAND) -> DataFrame:
    """The leaves with subroot and proof. tops: tree, subroot and proof of each tree's top node.

    What a block gets from above is a row among its own, the first of them.
    """
    above = tops.select("tree", F.lit(0).cast("long").alias("number"), "subroot", "proof")
    for base, nodes in reversed([*enumerate(bands)]):
        own = [c for c in nodes.columns if c not in ("tree", "number")]
        out = schema(nodes, ["tree", "number", *own], f"subroot string, proof {PROOF}")
        fields = arrow_schema(out)

        def down(batches: Iterator[pa.RecordBatch], base: int = base * band, fields: pa.Schema = fields) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                top, rows = block.slice(0, 1).to_pylist()[0], block.slice(1).combine_chunks()
                levels = max(min(band, height(rows.column("size")[0].as_py(), fanout) - base), 0)
                found = sweep_up(rows.column("digest").to_pylist(), levels, fanout)
                proof = _proofs([*sweep_down(found, [(s["before"], s["behind"]) for s in top["proof"]], fanout)], fields.field("proof").type)
                added = {"subroot": pa.array([top["subroot"]] * rows.num_rows, pa.string()), "proof": proof}
                yield from pa.Table.from_arrays([added[f.name] if f.name in added else rows.column(f.name).cast(f.type) for f in fields], schema=fields).to_batches()

        block = F.floor(F.col("number") / F.lit(fanout**band))
        rows = nodes.withColumn("block", block).unionByName(above.select("tree", F.col("number").alias("block"), F.lit(-1).cast("long").alias("number"), "subroot", "proof"), allowMissingColumns=True)
        above = _dealt(rows, fanout, band).mapInArrow(down, out)
        if base:
            above = stage(above.select("tree", "number", "subroot", "proof"), "proofs")
    return above


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with number (from 0, among the rows of equal keys, in this order) and size (how many those are). One range sort."""
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    place = [*keys, *order, "_row"]
    placed = placed.repartitionByRange(*place).sortWithinPartitions(*place).drop("_row").withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_part", F.shiftright("_place", 33)), "sorted")
    parts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row for each sorted part that holds rows of a key.
    same = Window.partitionBy(*keys)
    before = F.sum("_rows").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stage(parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(same).alias("size")), "parts")
    on = placed["_part"] == parts["_p"]
    for key in keys:
        on = on & placed[key].eqNullSafe(parts[f"_{key}"])
    joined = placed.join(parts, on)
    return joined.select(*(placed[c] for c in rows.columns), (F.col("_place") + F.col("_shift")).alias("number"), "size")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", keep: list[str] | None = None, fanout: int = FANOUT, band: int = BAND) -> DataFrame:
    """Per row of docs: id, leaf, subroot, root, proof (before and behind, level by level from the leaf to the root) and kept (a struct of the columns in keep)."""
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("string")
    leaves = docs.select(F.col(group_col).alias("tree"), F.col(id_col).alias("id"), leaf(*fields).alias("digest"), kept.alias("kept"))
    tops, bands = climb(numbered(stage(leaves, "rows"), ["tree"], ["id", "digest"]), fanout, band)
    # The subroots are the leaves of one more tree.
    groups = tops.select(F.col("tree").alias("id"), "digest")
    root, upper = climb(numbered(groups.withColumn("tree", F.lit("")), ["tree"], ["id"]), fanout, band)
    first = root.first()
    start = root.select("tree", F.col("digest").alias("subroot"), F.from_json(F.lit("[]"), PROOF).alias("proof"))
    subroots = stage(descend(upper, start, fanout, band).select(F.col("id").alias("tree"), F.col("digest").alias("subroot"), "proof"), "subroots")
    proven = descend(bands, subroots, fanout, band)
    return proven.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(first["digest"] if first else None).cast("string").alias("root"), "proof", "kept")
