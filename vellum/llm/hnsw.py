"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt into shards by hash. A shard's graph is kept as flat arrays:
its nodes are ordered by falling level, so that the nodes of a level are the first ones
and a level's links are one array of (nodes, links) node numbers, -1 where there is
none. As in the usual insertion, a node links to diverse ones of the nearest nodes that
came before it, and these link back, as far as their places go; but the nearest ones are
found for a block of nodes at a time by a matrix product, not by a walk for each node,
which is exact and takes a tenth of the time. Queries go in blocks to every shard of
their dimension, where they walk the graph, and shard results are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import ship, store

#: Distinct vectors of a graph on average, and queries that meet a graph in one task.
SHARD_VECTORS, QUERY_BLOCK = 16_384, 8_192
LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH = 64, 200
NEIGHBOURS = 10
SEED = 11
#: Doubles that a step of building a graph holds at once.
STEP = 1 << 22

INDEX_SCHEMA = "dim int, shard int, vectors binary, ids binary, copies binary, sizes array<int>, links array<binary>"


class Graph:
    """The graph over rows of ``vectors`` (doubles, ordered by falling level)."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.seen, self.stamp = np.zeros(len(vectors), np.int64), 0

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int]) -> Graph:
        """The graph of nodes inserted in order; ``sizes`` has the number of nodes of each level from 0 up."""
        graph = cls(vectors, [])
        graph.links = [graph._linked(n, 2 * LINKS if k == 0 else LINKS) for k, n in enumerate(sizes)]
        return graph

    def _linked(self, n: int, most: int) -> np.ndarray:
        """Links of a level of the first ``n`` nodes."""
        nodes, others, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        begin = 1
        while begin < n:
            end = min(n, begin + max(1, STEP // (n + BUILD_WIDTH * (BUILD_WIDTH + self.vectors.shape[1]))))
            block = np.arange(begin, end)
            found, distance = self._before(block)
            chosen = self._diverse(found, distance, LINKS)
            row, place = np.nonzero(chosen)
            nodes.append(block[row])
            others.append(found[row, place])
            far.append(distance[row, place])
            begin = end
        a, b, d = np.concatenate(nodes), np.concatenate(others), np.concatenate(far)
        return self._fitted(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]), n, most)

    def _before(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BUILD_WIDTH nearest nodes before each node of the block, nearest first, and squared distances; infinite where there are fewer."""
        end = int(block[-1])
        distance = self.squares[block][:, None] + self.squares[None, :end] - 2.0 * (self.vectors[block] @ self.vectors[:end].T)
        distance[np.arange(end)[None, :] >= block[:, None]] = np.inf
        width = min(BUILD_WIDTH, end)
        found = np.argpartition(distance, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(distance, found, axis=1)
        order = np.argsort(near, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(near, order, axis=1)

    def _diverse(self, found: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
        """Which of the nodes found to link to: they lie in different directions; one nearer to a chosen link waits for a free place."""
        there = np.isfinite(distance)
        v = self.vectors[found]
        among = self.squares[found][:, :, None] + self.squares[found][:, None, :] - 2.0 * (v @ v.transpose(0, 2, 1))
        blocked, chosen, count = ~there, np.zeros(found.shape, bool), np.zeros(len(found), np.int64)
        for k in range(found.shape[1]):
            take = ~blocked[:, k] & (count < most)
            chosen[:, k] = take
            count += take
            blocked |= take[:, None] & (among[:, k, :] < distance)
        waiting = there & ~chosen
        return chosen | (waiting & (np.cumsum(waiting, axis=1) <= (most - count)[:, None]))

    def _fitted(self, a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int, most: int) -> np.ndarray:
        """Links of nodes a to b as an array of ``most`` places a node; where they are more, diverse ones of the nearest 4 * most."""
        order = np.lexsort((b, far, a))
        a, b, far = a[order], b[order], far[order]
        counts = np.bincount(a, minlength=n)
        place = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        links = np.full((n, most), -1, np.int32)
        fits = (counts[a] <= most) & (place < most)
        links[a[fits], place[fits]] = b[fits]
        wide = 4 * most
        many = np.nonzero(counts > most)[0]
        step = max(1, STEP // (wide * (wide + self.vectors.shape[1])))
        starts = np.cumsum(counts) - counts
        for k in range(0, len(many), step):
            block = many[k : k + step]
            at = starts[block][:, None] + np.arange(wide)
            there = np.arange(wide) < counts[block][:, None]
            at = np.where(there, at, starts[block][:, None])
            found, distance = b[at], np.where(there, far[at], np.inf)
            row, kept = np.nonzero(self._diverse(found, distance, most))
            within = np.arange(len(row)) - np.searchsorted(row, row)
            links[block[row], within] = found[row, kept]
        return links

    def _far(self, nodes: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Squared distances less the query's square, which orders alike."""
        return self.squares[nodes] - 2.0 * (self.vectors[nodes] @ query)

    def _layer(self, query: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found on a level, nearest first."""
        self.stamp += 1
        seen, links = self.seen, self.links[level]
        for _, node in start:
            seen[node] = self.stamp
        near = [(-d, n) for d, n in start]
        open_ = list(start)
        heapq.heapify(near)
        heapq.heapify(open_)
        while open_:
            d, node = heapq.heappop(open_)
            if len(near) >= width and d > -near[0][0]:
                break
            around = links[node]
            around = around[around >= 0]
            around = around[seen[around] != self.stamp]
            if not len(around):
                continue
            seen[around] = self.stamp
            for far, other in zip(self._far(around, query).tolist(), around.tolist(), strict=True):
                if len(near) < width:
                    heapq.heappush(near, (-far, other))
                    heapq.heappush(open_, (far, other))
                elif far < -near[0][0]:
                    heapq.heapreplace(near, (-far, other))
                    heapq.heappush(open_, (far, other))
        return sorted((-d, n) for d, n in near)

    def _entry(self, query: np.ndarray, down_to: int, top: int) -> list[tuple[float, int]]:
        start = [(float(self._far(np.array([0]), query)[0]), 0)]
        for level in range(top, down_to, -1):
            start = self._layer(query, start, 1, level)[:1]
        return start

    def search(self, query: np.ndarray, width: int) -> np.ndarray:
        """Nodes near the query; those of a graph no larger than the width are all looked at."""
        if len(self.vectors) <= width:
            return np.arange(len(self.vectors))
        return np.array([n for _, n in self._layer(query, self._entry(query, 0, len(self.links) - 1), width, 0)])


def _levels(n: int, seed: int) -> list[int]:
    """Number of nodes of each level from 0 up, as drawn by the usual exponential rule."""
    drawn = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    drawn[0] = drawn.max()
    return [int((drawn >= k).sum()) for k in range(drawn.max() + 1)]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().cast(pa.float64())
    return np.asarray(flat).reshape(-1, dim)


def _build(table: pa.Table) -> pa.Table:
    """One index row from the distinct vectors of a shard, each with the smallest ids that bear it."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    # The hash order is the insertion order, whatever order the rows came in.
    table = table.sort_by([("mark", "ascending"), ("first", "ascending")])
    vectors = _matrix(table["embedding"], dim)
    sizes = _levels(len(vectors), SEED + shard)
    graph = Graph.build(vectors, sizes)
    ids = table["ids"].combine_chunks()
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([shard], pa.int32()),
            "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([np.asarray(ids.flatten()).astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([np.asarray(ids.value_lengths()).astype("<i4").tobytes()], pa.binary()),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "links": pa.array([[x.astype("<i4").tobytes() for x in graph.links]], pa.list_(pa.binary())),
        }
    )


def _search(index: pa.Table, queries: pa.Table) -> pa.Table:
    """The nearest ids of a shard for each query, with exact distances."""
    asked, marks, found, far = [], [], [], []
    if index.num_rows and queries.num_rows:
        row = {c: index[c][0].as_py() for c in index.column_names}
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        links = [np.frombuffer(x, "<i4").reshape(n, -1) for x, n in zip(row["links"], row["sizes"], strict=True)]
        graph = Graph(vectors, links)
        ids = np.frombuffer(row["ids"], "<i8")
        ends = np.cumsum(np.frombuffer(row["copies"], "<i4"))
        starts = np.concatenate([[0], ends[:-1]])
        points = _matrix(queries["embedding"], row["dim"])
        for query_id, mark, query in zip(queries["query_id"].to_pylist(), queries["mark"].to_pylist(), points, strict=True):
            nodes = graph.search(query, SEARCH_WIDTH)
            distance = np.sqrt(((vectors[nodes] - query) ** 2).sum(axis=1))
            ranked: list[tuple[float, int]] = []
            for k in np.argsort(distance, kind="stable"):
                if len(ranked) >= NEIGHBOURS and distance[k] > ranked[NEIGHBOURS - 1][0]:
                    break
                ranked += [(float(distance[k]), int(i)) for i in ids[starts[nodes[k]] : ends[nodes[k]]] if i != query_id]
            for d, i in sorted(ranked)[:NEIGHBOURS]:
                asked.append(query_id)
                marks.append(mark)
                found.append(i)
                far.append(d)
    return pa.table({"query_id": pa.array(asked, pa.int64()), "mark": pa.array(marks, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(far, pa.float64())})


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, every component finite."""
    big = float("inf")
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (x != big) & (x != -big), F.lit(False)))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame) -> DataFrame:
    """``INDEX_SCHEMA`` rows over usable ``vec_id, embedding``; all rows are indexed.

    Equal vectors are one node. It carries their NEIGHBOURS + 1 smallest ids: since ties
    go to the smaller id, no other copy can be among the nearest of any query.
    """
    unique = vectors.select("vec_id", "embedding").distinct()
    few = unique.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("n") <= NEIGHBOURS + 1)
    nodes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = nodes.select(F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("mark"), F.element_at("ids", 1).alias("first"), "ids", "embedding")
    nodes = store(nodes, "nodes")
    shards = max(1, -(-nodes.count() // SHARD_VECTORS))
    dealt = nodes.withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int"))
    return store(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX_SCHEMA), "graphs")


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of all shards for each query (query_id, embedding).

    ``index`` and ``queries`` should be stored. A graph meets QUERY_BLOCK queries at a
    time, so a task holds one graph and one block, however many queries there are.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    mark = F.xxhash64("embedding")
    asked = queries.select("query_id", "embedding").distinct().select("query_id", "embedding", F.size("embedding").alias("dim"), mark.alias("mark"), F.pmod(F.xxhash64("query_id", mark), F.lit(blocks)).cast("int").alias("block"))
    sent = asked.join(index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard")), F.col("dim") == F.col("of_dim"))
    graphs = index.withColumn("of_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = graphs.groupBy("dim", "shard", "of_block").cogroup(sent.groupBy("of_dim", "of_shard", "block")).applyInArrow(_search, "query_id long, mark long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column) -> DataFrame:
    """Each query's nearest of all other rows by Euclidean distance, ties to the smaller vec_id.

    Rows without vec_id and vectors that are null, empty, zero or not finite take no
    part; vectors are compared with those of their own length. Rows that repeat an id
    and vector are one candidate. Extra columns are not read; empty tables give none.
    """
    kept = store(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))), "vectors")
    return search(build_index(kept), kept.filter("asks").select(F.col("vec_id").alias("query_id"), "embedding"))


ship(__name__)
