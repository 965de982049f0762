"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams.

The vectors are dealt to shards by a hash of their id, so shards are even
however often one vector occurs. In a shard equal vectors are one node. Nodes
are inserted in random order, in growing batches: a greedy beam search over the
graph so far proposes neighbours, relaxed distance pruning keeps those that no
kept one stands well in front of, and the kept ones get a link back, pruned in
turn when they have too many. Every query is beam-searched in every shard; the
proposals are scored again in double precision, and the nearest of all shards
are kept.

Defined cases: rows whose id or vector is null, whose vector is empty or zero,
or holds a null or non-finite component, take no part. Rows of one id are one
row (the smallest vector counts). Vectors of different lengths aren't
comparable: they have shards of their own, and queries meet vectors of their
length only. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import stage

#: Vectors of a shard, on average.
SHARD_ROWS = 4096
#: Links that pruning keeps, room for links back before a node is pruned again, nodes a building and a searching beam holds, and how much nearer a kept neighbour must stand to prune.
DEGREE, ROOM, BUILD_BEAM, BEAM, RELAXED = 24, 16, 48, 64, 1.2
#: Queries that travel together, and searches that advance in step.
BLOCK = 128
#: Blocks of queries that a task searches in one shard at most, on average.
CHUNK_BLOCKS = 32
SEED = 7


class Graph:
    """The nodes of one shard (rows of `vectors`) and their links (-1: none)."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray, entry: int) -> None:
        self.vectors, self.links, self.entry = vectors, links, entry
        self.squares = np.einsum("ij,ij->i", vectors, vectors)

    def distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes."""
        return self.squares[nodes] - 2 * np.einsum("qd,qnd->qn", queries, self.vectors[nodes]) + np.einsum("qd,qd->q", queries, queries)[:, None]

    def beam_search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query, nearest first: nodes (-1: none) and squared distances. All queries advance in step."""
        n = len(queries)
        nodes, near = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.vectors)), bool)
        nodes[:, 0], opened[:, 0], seen[:, self.entry] = self.entry, False, True
        near[:, 0] = self.distances(queries, np.full((n, 1), self.entry))[:, 0]
        busy = np.arange(n)
        while len(busy):
            at = np.argmin(opened[busy], axis=1)
            opened[busy, at] = True
            ahead = self.links[nodes[busy, at]]
            known = (ahead < 0) | seen[busy[:, None], ahead]
            seen[busy[:, None], np.where(ahead < 0, self.entry, ahead)] = True
            far = np.where(known, np.inf, self.distances(queries[busy], np.maximum(ahead, 0))).astype(np.float32)
            all_near = np.concatenate([near[busy], far], axis=1)
            order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            near[busy] = np.take_along_axis(all_near, order, 1)
            nodes[busy] = np.where(np.isinf(near[busy]), -1, np.take_along_axis(np.concatenate([nodes[busy], ahead], axis=1), order, 1))
            opened[busy] = np.take_along_axis(np.concatenate([opened[busy], known], axis=1), order, 1) | (nodes[busy] < 0)
            busy = busy[~opened[busy].all(axis=1)]
        return nodes, near

    def prune(self, nodes: np.ndarray, proposed: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
        """New links of each node: of its row of proposals (-1: none), nearest first, those that no kept one stands `relaxed` times nearer to."""
        rows, proposed = np.arange(len(nodes)), np.sort(proposed, axis=1)
        none = (proposed < 0) | (proposed == nodes[:, None])
        none[:, 1:] |= proposed[:, 1:] == proposed[:, :-1]
        own = np.where(none, np.inf, self.distances(self.vectors[nodes], np.maximum(proposed, 0)))
        order = np.argsort(own, axis=1, kind="stable")[:, : max(1, int((~none).sum(axis=1).max(initial=0)))]
        proposed, own = np.take_along_axis(proposed, order, 1), np.take_along_axis(own, order, 1)
        places, squares = self.vectors[np.maximum(proposed, 0)], self.squares[np.maximum(proposed, 0)]
        between = squares[:, :, None] + squares[:, None, :] - 2 * places @ places.transpose(0, 2, 1)
        alive, kept = np.isfinite(own), np.zeros(own.shape, bool)
        for _ in range(degree):
            best = np.argmax(alive, axis=1)
            some = alive[rows, best]
            if not some.any():
                break
            kept[rows, best] |= some
            alive &= relaxed * relaxed * between[rows, best] > own
            alive[rows, best] = False
        order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
        links = np.full((len(nodes), degree), -1)
        links[:, : order.shape[1]] = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(proposed, order, 1), -1)
        return links


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, seed: int = SEED) -> Graph:
    """The graph over distinct vectors (float32 rows)."""
    n, width = len(vectors), degree + ROOM
    links = np.full((n, width), -1)
    entry = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    graph = Graph(vectors, links, entry)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        fresh = order[at : at + max(1, min(at, BLOCK))]
        at += len(fresh)
        found, _ = graph.beam_search(vectors[fresh], beam)
        # Those of one batch don't meet in the search, so the nearest of them are proposed too.
        among = graph.distances(vectors[fresh], np.broadcast_to(fresh, (len(fresh), len(fresh))))
        nearest = fresh[np.argsort(among, axis=1, kind="stable")[:, : degree // 2]]
        links[fresh, :degree] = graph.prune(fresh, np.concatenate([found, nearest], axis=1), degree, relaxed)
        # Links back: the new ones of each neighbour in a row of their own, beside those it has.
        node, to = np.repeat(fresh, degree), links[fresh, :degree].ravel()
        node, to = node[to >= 0], to[to >= 0]
        by_target = np.argsort(to, kind="stable")
        node, to = node[by_target], to[by_target]
        targets, first, many = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(targets), many.max(initial=0)), -1)
        more[np.repeat(np.arange(len(targets)), many), np.arange(len(to)) - np.repeat(first, many)] = node
        wanted = -np.sort(-np.concatenate([links[targets], more], axis=1), axis=1)
        wanted[:, 1:][wanted[:, 1:] == wanted[:, :-1]] = -1
        wanted = -np.sort(-wanted, axis=1)
        has = (wanted >= 0).sum(axis=1)
        roomy = has <= width
        links[targets[roomy]] = np.pad(wanted[roomy], ((0, 0), (0, max(0, width - wanted.shape[1]))), constant_values=-1)[:, :width]
        crowded = np.flatnonzero(~roomy)
        crowded = crowded[np.argsort(has[crowded], kind="stable")]
        for some in (crowded[i : i + BLOCK] for i in range(0, len(crowded), BLOCK)):
            links[targets[some], :degree] = graph.prune(targets[some], wanted[some], degree, relaxed)
            links[targets[some], degree:] = -1
    return graph


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (double) of the rows that take part, one row an id."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull()).filter(usable(F.col("vector")))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> DataFrame:
    """One row a shard: its key, length of vectors, nodes' vectors (double), links, entry, and the ids at each node. Written to the shared folder.

    A shard holds about shard_rows vectors, whatever the table's size.
    """
    rows = stage(clean(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = rows.withColumn("width", F.size("vector")).join(F.broadcast(sizes), "width").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        exact = np.stack(rows["vector"].to_numpy())
        nodes, of = np.unique(exact, axis=0, return_inverse=True)
        graph = build(nodes.astype(np.float32), degree, beam, relaxed)
        ids = rows["id"].to_numpy(np.int64)
        order = np.argsort(of.ravel(), kind="stable")  # by node, then by id
        starts = np.searchsorted(of.ravel()[order], np.arange(len(nodes) + 1))
        return pd.DataFrame({
            "width": [key[0]], "shard": [key[1]], "entry": [graph.entry], "nodes": [nodes.tobytes()], "links": [graph.links.astype(np.int32).tobytes()],
            "degree": [graph.links.shape[1]], "ids": [ids[order].tobytes()], "starts": [starts.astype(np.int64).tobytes()],
        })

    made = dealt.select("width", "shard", "id", "vector").groupBy("width", "shard").applyInPandas(
        make, "width int, shard long, entry long, nodes binary, links binary, degree int, ids binary, starts binary"
    )
    return stage(made, "graphs")


class Shard:
    """A shard of the index, read back."""

    def __init__(self, row: dict) -> None:
        self.exact = np.frombuffer(row["nodes"]).reshape(-1, row["width"])
        self.graph = Graph(self.exact.astype(np.float32), np.frombuffer(row["links"], np.int32).reshape(-1, row["degree"]).astype(np.int64), row["entry"])
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, distance): each query's k nearest ids here, of the nodes its beam ends with."""
        found, _ = self.graph.beam_search(queries.astype(np.float32), max(beam, k + 1))
        for query, vector, nodes in zip(ids.tolist(), queries, found, strict=True):
            nodes = nodes[nodes >= 0]
            distances = np.sqrt(((self.exact[nodes] - vector) ** 2).sum(axis=1))
            # Copies share a node; of each node the smallest k + 1 ids are enough.
            best = sorted((d, int(i)) for d, node in zip(distances.tolist(), nodes) for i in self.ids[self.starts[node] : self.starts[node + 1]][: k + 1] if i != query)[:k]
            yield from ((query, i, d) for d, i in best)


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself excluded.

    Queries travel in blocks. A task searches at most CHUNK_BLOCKS blocks in one
    shard; the shard's graph is sent once for each such chunk.
    """
    rows = clean(queries, id_col, vector_col).withColumn("width", F.size("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for width, same in frame.groupby("width"):
                for at in range(0, len(same), BLOCK):
                    block = same.iloc[at : at + BLOCK]
                    yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "queries": [block["id"].to_numpy(np.int64).tobytes()], "places": [np.stack(block["vector"].to_numpy()).tobytes()]})

    blocks = stage(rows.select("id", "vector", "width").mapInArrow(pack, "width int, queries binary, places binary"), "query-blocks")
    chunks = max(1, -(-blocks.count() // CHUNK_BLOCKS))
    shards = index.groupBy("width").agg(F.max("shard").alias("last"))
    spread = blocks.join(F.broadcast(shards), "width").select("width", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), F.pmod(F.xxhash64("queries"), F.lit(chunks)).alias("chunk"), "queries", "places")
    graphs = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def run(_: tuple, graph: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(graph) and len(blocks):
            shard = Shard(graph.iloc[0])
            for raw, places in zip(blocks["queries"], blocks["places"], strict=True):
                ids = np.frombuffer(raw, np.int64)
                found += shard.nearest(ids, np.frombuffer(places).reshape(len(ids), -1), k, beam)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = graphs.groupBy("width", "shard", "chunk").cogroup(spread.groupBy("width", "shard", "chunk")).applyInPandas(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
