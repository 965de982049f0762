"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within `distance` bits agree fully on one of distance + 1 segments,
so each distinct fingerprint goes to one bucket for each segment; a bucket that
is still too large is dealt again by the segments of its remaining bits. Within
a task fingerprints are sorted by bucket and Gray rank, which puts like ones
side by side. Above them stands a tree: a node holds the bits all its rows share
(mask and pattern). Two nodes are compared on the bits that both masks hold; the
differences add up on the way down, and as soon as they exceed `distance` the
whole pair of groups is pruned. Pairs of nodes that are one component already
are pruned as well, so a large group of copies costs no square of its size.

A task puts out a link from each fingerprint to the root of its component in
that task, not pairs. Components across tasks come from alternating large-star
and small-star steps.

Defined cases: a null text is an empty one; texts without words have fingerprint
zero. Equal fingerprints are one node. Rows with null or repeated ids each get
their fingerprint and component; a component's id is its smallest id that isn't
null. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import arrow_schema, fresh, schema, slices
from runledger.session import stage

#: Words of a shingle, and bits by which linked fingerprints differ at most.
SHINGLE, DISTANCE = 3, 3
HASH_SEED = 42
#: A bucket with more rows is dealt again by its remaining bits, so often at most.
BUCKET_ROWS, DEALS = 4096, 2
#: Children of a node, rows a task indexes at once (buckets are kept whole), and pairs it compares at once.
FANOUT, INDEX_ROWS, PAIRS = 8, 200_000, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: bits set in over half of the shingles' XXH64 (lower case A-Z, words between ASCII white space)."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)
    joined = zip(*(words[i : i + n] for i in range(shingle)), strict=True) if len(words) >= shingle else [words]
    votes = np.zeros(64, np.int64)
    hashes = np.fromiter(map(digest, map(b" ".join, joined)), np.uint64, n)
    for at in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and f (the fingerprint as a signed long), one row per row of docs."""
    out = schema(docs.select(id_col), [id_col], "f long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(out)
        for batch in slices(batches):
            found = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], schema=fields)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def gray_rank(f: Column) -> Column:
    """Where a bit pattern stands in the Gray sequence: each bit becomes the parity of itself and those above."""
    for step in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, step))
    return f


def _segments(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(bits, parts)]


def buckets(nodes: DataFrame, distance: int = DISTANCE, limit: int = BUCKET_ROWS, deals: int = DEALS) -> DataFrame:
    """(bucket, f): every fingerprint once for each of its buckets; fingerprints within `distance` share one at least.

    The first deal takes consecutive bits as segments. Buckets over `limit` are
    dealt again, each by segments of the bits it doesn't fix, `deals` times at
    most: what is left large agrees on most of its bits already.
    """
    first = _segments(list(range(64)), distance + 1)
    below = lambda path, bits: F.struct(F.lit(path).alias("path"), F.col("f").bitwiseAND(_mask(bits)).alias("value"))
    rows = nodes.select("f", F.explode(F.array(*(below(str(i), bits) for i, bits in enumerate(first)))).alias("b")).select("f", "b.path", "b.value")
    free = {str(i): [x for j, bits in enumerate(first) if j != i for x in bits] for i in range(distance + 1)}
    done = []
    for _ in range(deals):
        rows = stage(rows, "buckets")
        large = stage(rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("path", "value"), "large-buckets")
        if large.isEmpty():
            break
        done.append(rows.join(large, ["path", "value"], "left_anti"))
        again, deeper = rows.join(large, ["path", "value"], "left_semi"), {}
        split = None
        for path, bits in free.items():
            options = []
            for i, part in enumerate(_segments(bits, distance + 1)):
                name = f"{path}.{i}"
                fixed = [x for x in range(64) if x not in bits] + part
                options.append(below(name, fixed))
                deeper[name] = [x for x in bits if x not in part]
            split = F.when(F.col("path") == path, F.array(*options)) if split is None else split.when(F.col("path") == path, F.array(*options))
        rows = again.select("f", F.explode(split).alias("b")).select("f", "b.path", "b.value")
        free = deeper
    for part in done:
        rows = rows.unionByName(part)
    return rows.select(F.xxhash64("path", "value").alias("bucket"), "f")


def _mask(bits: list[int]) -> Column:
    value = sum(1 << b for b in bits)
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


class Components:
    """Union-find over row numbers, joined in bulk."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            differ = low != high
            if not differ.any():
                return
            left, right = left[differ], right[differ]
            np.minimum.at(self.root, high[differ], low[differ])
            self.flatten()

    def flatten(self) -> None:
        while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = deeper


class Level:
    """The nodes over `size` rows each: shared bits, buckets they span, and whether they are one component."""

    def __init__(self, f: np.ndarray, bucket: np.ndarray, root: np.ndarray, size: int) -> None:
        starts = np.arange(0, len(f), size)
        every, some = np.bitwise_and.reduceat(f, starts), np.bitwise_or.reduceat(f, starts)
        self.mask, self.pattern = ~(every ^ some), every
        ends = np.minimum(starts + size, len(f)) - 1
        self.first, self.last = bucket[starts], bucket[ends]
        low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
        self.single = np.where(low == high, low, -1 - np.arange(len(starts)))


def links(bucket: np.ndarray, f: np.ndarray, distance: int = DISTANCE, pairs: int = PAIRS) -> np.ndarray:
    """The root row of each row. Rows come sorted by bucket, then Gray rank; only rows of one bucket are compared."""
    n = len(f)
    joined = Components(n)
    for step in (1, 2, 3):  # Gray neighbours first: most of a group of near copies is one component after this
        near = np.flatnonzero((bucket[step:] == bucket[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance)) if n > step else np.empty(0, np.int64)
        joined.join(near, near + step)
    sizes = [FANOUT]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * FANOUT)
    levels = [Level(f, bucket, joined.root, size) for size in sizes]

    def apart(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes that may hold links not yet known."""
        differing = np.bitwise_count((level.pattern[a] ^ level.pattern[b]) & level.mask[a] & level.mask[b])
        return (differing <= distance) & (level.last[a] >= level.first[b]) & (level.single[a] != level.single[b])

    def expand(a: np.ndarray, b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children, each once."""
        grid = np.arange(FANOUT)
        left = (a[:, None, None] * FANOUT + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
        right = (b[:, None, None] * FANOUT + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
        fit = (left <= right) & (right < total)
        return left[fit], right[fit]

    # Depth first over blocks of pairs, so that few pairs are held at a time.
    work = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    block = max(1, pairs // FANOUT**2)
    while work:
        depth, a, b = work.pop()
        if len(a) > block:
            work.append((depth, a[block:], b[block:]))
            a, b = a[:block], b[:block]
        left, right = expand(a, b, -(-n // sizes[depth - 1]) if depth else n)
        if depth:
            level = levels[depth - 1]
            # A node stays with itself: its own rows may hold links, unless they are one component.
            same = left == right
            kept = np.where(same, level.single[left] < 0, apart(level, left, right))
            if kept.any():
                work.append((depth - 1, left[kept], right[kept]))
        else:
            close = (left < right) & (bucket[left] == bucket[right])
            left, right = left[close], right[close]
            close = np.bitwise_count(f[left] ^ f[right]) <= distance
            joined.join(left[close], right[close])
    return joined.root


def star_links(bucketed: DataFrame, distance: int = DISTANCE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(f, root): each linked fingerprint and the root of its component within a task; no pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            root = links(bucket, f.view(np.uint64), distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(f[moved]), pa.array(f[root[moved]])], names=["f", "root"])

        held_bucket, held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            held_bucket = np.concatenate([held_bucket, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy()])
            if len(held) >= index_rows and (cut := int(np.searchsorted(held_bucket, held_bucket[-1]))):
                yield found(held_bucket[:cut], held[:cut])
                held_bucket, held = held_bucket[cut:], held[cut:]
        if len(held):
            yield found(held_bucket, held)

    rank = gray_rank(F.col("f"))
    return bucketed.repartition("bucket").sortWithinPartitions("bucket", rank).select("bucket", "f").mapInArrow(run, "f long, root long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(f, root) for every end of an edge (f, root): the smallest fingerprint of its component.

    Alternates large-star (a node's larger neighbours go to its smallest) and
    small-star (its smaller ones do) until nothing changes, in a number of
    rounds that grows with the logarithm of the edges. A node with very many
    neighbours is aggregated in the map tasks, then joined, where AQE splits it.
    """
    edges = stage(edges.filter("f <> root").select(F.greatest("f", "root").alias("u"), F.least("f", "root").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stage(small, "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("f"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of docs: id, f (fingerprint), root (its component's smallest fingerprint), component_id, documents (of the component)."""
    rows = stage(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "id", "body", shingle), "fingerprints")
    nodes = stage(rows.groupBy("f").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = components(star_links(buckets(nodes, distance), distance))
    rooted = nodes.join(linked, "f", "left").withColumn("root", F.coalesce("root", "f"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("documents"))
    placed = stage(rooted.select("f", "root").join(groups, "root"), "components")
    return rows.join(placed, "f").select(F.col("id").alias(id_col), "f", "root", "component_id", "documents")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id (nulls last) stays.

    Rows are known by id and text hash; of several with both alike one stays.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    found = stage(near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("body")), "key", "body", shingle, distance).select("key", "component_id"), "near-duplicates")
    chosen_id, chosen_hash = fresh(docs.columns, "chosen_id", "chosen_hash")
    chosen = stage(found.select(F.col("component_id.id").alias(chosen_id), F.col("component_id.text_hash").alias(chosen_hash)).distinct(), "chosen")
    kept = docs.join(chosen, docs[id_col].eqNullSafe(chosen[chosen_id]) & (F.xxhash64(docs[text_col]) == chosen[chosen_hash]), "left_semi")
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
