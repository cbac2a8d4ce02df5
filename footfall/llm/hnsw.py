"""Approximate nearest neighbours with one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of a fixed size by hash. A task builds the graph of its shard and stores it as flat
neighbour arrays, one row of a table per shard. A query walks the graph of every shard, and the nearest of all shards
are merged with their exact distances.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.vectors import matrix, usable
from footfall.sources.staging import stage

#: Vectors of a shard, about; queries of a block, about.
SHARD, BLOCK = 4096, 1024
#: Neighbours of a node (twice as many on the ground level), candidates for them, and candidates of a search.
NEIGHBOURS, BUILD, SEARCH = 16, 64, 96
#: Nodes that are inserted together.
STEP = 128


class Graph:
    """``links[level]`` has one row of neighbours per node of that level, filled up with -1; ``rows[level]`` says which row
    a node has there. Nodes are in the order of insertion."""

    def __init__(self, vectors: np.ndarray, rows: list[np.ndarray], links: list[np.ndarray], entry: int):
        self.vectors, self.rows, self.links, self.entry = vectors, rows, links, entry
        self.norms = np.einsum("ij,ij->i", vectors, vectors)

    @classmethod
    def build(cls, vectors: np.ndarray, neighbours: int = NEIGHBOURS, candidates: int = BUILD, seed: int = 0) -> Graph:
        n = len(vectors)
        height = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(neighbours), 12).astype(int)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        rows, links = [], []
        for level in range(int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height >= level)
            row = np.full(n, -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            rows.append(row)
            links.append(cls._level(vectors, norms, nodes, neighbours * (2 if level == 0 else 1), neighbours, candidates))
        return cls(vectors, rows, links, int(np.argmax(height)))

    @staticmethod
    def _level(vectors: np.ndarray, norms: np.ndarray, nodes: np.ndarray, most: int, wanted: int, candidates: int) -> np.ndarray:
        """Insert the nodes of a level in order: each is linked with a spread selection of the nearest of those before it,
        and they with it. Nodes of one step see those before the step, and each other."""
        near: list[list[int]] = [[] for _ in nodes]

        def spread(at: int, others: np.ndarray, distances: np.ndarray, limit: int) -> list[int]:
            """The nearest first; one that lies nearer to a chosen one than to the node is left to that one."""
            order = np.argsort(distances, kind="stable")
            others, distances = others[order], distances[order]
            x = vectors[nodes[others]]
            between = norms[nodes[others]][:, None] + norms[nodes[others]] - 2 * (x @ x.T)
            free, chosen = np.ones(len(others), bool), []
            for i in range(len(others)):
                if free[i]:
                    chosen.append(i)
                    if len(chosen) == limit:
                        break
                    free &= between[i] >= distances
            rest = [i for i in range(len(others)) if i not in set(chosen)] if len(chosen) < limit // 2 else []
            return others[chosen + rest[: limit // 2 - len(chosen)]].tolist()

        for start in range(0, len(nodes), STEP):
            new = nodes[start : start + STEP]
            known = nodes[: start + len(new)]
            distance = norms[new][:, None] + norms[known] - 2 * (vectors[new] @ vectors[known].T)
            for i in range(len(new)):
                before = distance[i, : start + i]
                if not len(before):
                    continue
                close = np.argpartition(before, candidates)[:candidates] if len(before) > candidates else np.arange(len(before))
                near[start + i] = spread(start + i, close, before[close], wanted)
                for other in near[start + i]:
                    near[other].append(start + i)
                    if len(near[other]) > most + wanted // 2:
                        own = np.array(near[other])
                        gap = norms[nodes[own]] + norms[nodes[other]] - 2 * (vectors[nodes[own]] @ vectors[nodes[other]])
                        near[other] = spread(other, own, gap, most)
        out = np.full((len(nodes), most + wanted // 2), -1, np.int32)
        for i, own in enumerate(near):
            out[i, : len(own)] = nodes[own]
        return out

    def search(self, query: np.ndarray, most: int, breadth: int = SEARCH) -> np.ndarray:
        """Nodes near a query, at most ``most``, the nearest first."""
        if not len(self.vectors):
            return np.zeros(0, np.int64)
        breadth = max(breadth, most)
        own = float(query @ query)
        gap = lambda nodes: self.norms[nodes] + own - 2 * (self.vectors[nodes] @ query)
        at = self.entry
        best = float(gap(np.array([at]))[0])
        for level in range(len(self.links) - 1, 0, -1):
            moved = True
            while moved:
                others = self.links[level][self.rows[level][at]]
                others, moved = others[others >= 0], False
                if len(others):
                    distances = gap(others)
                    i = int(distances.argmin())
                    if distances[i] < best:
                        at, best, moved = int(others[i]), float(distances[i]), True
        seen = np.zeros(len(self.vectors), bool)
        seen[at] = True
        todo, found = [(best, at)], [(-best, at)]
        ground = self.links[0]
        while todo:
            d, node = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= breadth:
                break
            others = ground[node]
            others = others[others >= 0]
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            distances = gap(others)
            if len(found) >= breadth:
                closer = distances < -found[0][0]
                others, distances = others[closer], distances[closer]
            for d, other in zip(distances.tolist(), others.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (-d, other))
                    heapq.heappush(todo, (d, other))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, other))
                    heapq.heappush(todo, (d, other))
        return np.array([node for _, node in sorted((-d, node) for d, node in found)[:most]], np.int64)


def distinct_vectors(rows: DataFrame, id_col: str, vector: str, most: int) -> DataFrame:
    """``vector, ids``: every distinct usable vector with the ``most`` smallest ids that hold it."""
    held = rows.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = held.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


INDEX = "dim int, shard int, n int, entry int, vectors {vectors}, ids array<array<long>>, rows array<array<int>>, links array<array<int>>"


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard of ``vector, ids``: vectors, ids, and per level the rows of nodes and the flat neighbour array.

    Vectors of different lengths never meet: the length is part of the shard. Those of floats are kept as floats, others as
    doubles.
    """
    dims = [(r.dim, max(1, -(-r.n // shard))) for r in vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()]
    shards = F.create_map(*(F.lit(x) for pair in dims for x in pair)) if dims else F.lit(None).cast("map<int,int>")
    dealt = vectors.withColumn("dim", F.size("vector"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vector"), F.element_at(shards, F.col("dim"))).cast("int"))
    kind = "array<float>" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    own = np.float32 if kind == "array<float>" else np.float64
    dealt = dealt.withColumn("vector", F.col("vector").cast(kind))
    # A graph is long work on few bytes: a fixed number of partitions is not put together again by size.
    dealt = dealt.repartition(sum(n for _, n in dims) or 1, "dim", "shard")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        x = np.array(rows["vector"].tolist(), np.float64)
        graph = Graph.build(x)
        one = (int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0]), len(x), graph.entry, x.ravel().astype(own), rows["ids"].tolist())
        return pd.DataFrame([(*one, graph.rows, [link.ravel() for link in graph.links])], columns=["dim", "shard", "n", "entry", "vectors", "ids", "rows", "links"])

    return dealt.groupBy("dim", "shard").applyInPandas(build, INDEX.format(vectors=kind))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, breadth: int = SEARCH) -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: the ``k`` rows nearest to each query that the graphs find,
    by Euclidean distance in doubles, ties to the smaller id. The row with the query's own id is no candidate.

    Copies of a vector are one node; its ``k + 1`` smallest ids stand for it, which is all that a result can hold.
    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, on either side.
    Rows that repeat an id and its vector count once.
    """
    copies = distinct_vectors(rows.select(id_col, vector).distinct(), id_col, vector, k + 1)
    index = stage(build_index(stage(copies, "vectors"), shard), "hnsw")
    asked = queries.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("q")).distinct()
    asked = stage(asked.withColumn("dim", F.size("q")), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    places = index.select("dim", "shard")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(places, "dim")
    own = [F.col(c).alias(f"g_{c}" if c in ("dim", "shard") else c) for c in index.columns]
    graphs = index.select(*own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g_block"))

    def search(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for g in graphs.to_pylist():
            x = np.array(g["vectors"], np.float64).reshape(g["n"], -1)
            links = [np.array(link, np.int32).reshape(max(1, int((np.array(row) >= 0).sum())), -1) for row, link in zip(g["rows"], g["links"], strict=True)]
            graph = Graph(x, [np.array(row, np.int32) for row in g["rows"]], links, g["entry"])
            for own, q in zip(asked.column("query_id").to_pylist(), matrix(asked.column("q")), strict=True):
                nodes = graph.search(q, k + 1, breadth)
                scores = np.sqrt(((x[nodes] - q) ** 2).sum(axis=1))
                hits = sorted((s, i) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for i in g["ids"][node] if i != own)[:k]
                out["query_id"] += [own] * len(hits)
                out["vec_id"] += [i for _, i in hits]
                out["score"] += [s for s, _ in hits]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    pairs = dealt.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("g_dim", "g_shard", "g_block"))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


