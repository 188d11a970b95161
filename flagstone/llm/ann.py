"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

A shard holds a bounded number of distinct vectors. Its nodes are ordered by level, highest first,
so that each layer's nodes are the first of the next one's, and a layer is one flat array of
neighbours. Nodes are inserted in batches that grow with the graph, and many queries walk the graph
in lock step. Largest inner product is turned into smallest distance by one more component, which
brings all vectors of a shard to the same length. Vectors that occur many times are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.llm.common import ship, uniform, written

#: Neighbours of a node in the upper layers; in the lowest twice as many.
LINKS = 16
#: Nodes kept in view while a node is inserted, and while a query is answered.
VIEW_BUILD, VIEW_SEARCH = 96, 160
#: A query keeps at least so many nodes in view for each dimension: near ones get rarer with it.
VIEW_PER_DIMENSION = 6
#: Distinct vectors of a shard, and queries that search one shard in one task, on average.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
#: Nodes expanded per query and step, and queries or new nodes that go in lock step.
WIDTH, STEP_QUERIES = 4, 512


def distances(points: np.ndarray, rows: np.ndarray, query: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Squared distances of points[rows] to query[owner]."""
    gap = points[rows] - query[owner]
    return np.einsum("ij,ij->i", gap, gap)


def walk(points: np.ndarray, layer: np.ndarray, query: np.ndarray, entry: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``view`` nearest nodes met in ``layer`` from ``entry`` on: ids (-1: none) and distances, nearest first."""
    n_q, every = len(query), np.arange(len(query))
    ids, dist = np.full((n_q, view), -1, np.int32), np.full((n_q, view), np.inf, np.float32)
    done = np.ones((n_q, view), bool)
    seen = np.zeros((n_q, len(layer) + 1), bool)  # the last column takes what stands for no node
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = distances(points, entry, query, every)
    seen[every, entry] = True
    live = every
    while len(live):
        best = np.where(done[live], np.inf, dist[live])
        at = np.argpartition(best, WIDTH - 1, 1)[:, :WIDTH] if view > WIDTH else np.argsort(best, 1)[:, :WIDTH]
        open_ = np.isfinite(np.take_along_axis(best, at, 1))
        going = open_.any(1)
        live, at, open_ = live[going], at[going], open_[going]
        if not len(live):
            break
        nodes = np.where(open_, ids[live[:, None], at], -1)
        done[live[:, None], at] = True
        near = np.where(nodes[:, :, None] >= 0, layer[nodes], -1).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        owner, slot = np.nonzero(near >= 0)
        found = near[owner, slot]
        seen[live[owner], found] = True
        fresh = np.full(near.shape, np.inf, np.float32)
        fresh[owner, slot] = distances(points, found, query, live[owner])
        all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], fresh], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        keep = np.argpartition(all_dist, view - 1, 1)[:, :view]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_dist, all_done))
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def choose(points: np.ndarray, ids: np.ndarray, dist: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of each row's candidates (nearest first, -1: none): those nearer to the row's node than
    to any chosen before them, then the nearest of the others."""
    n, width = ids.shape
    body = points[ids]
    sq = np.einsum("ijk,ijk->ij", body, body)
    apart = sq[:, :, None] + sq[:, None, :] - 2 * body @ body.transpose(0, 2, 1)
    taken = np.zeros((n, width), bool)
    for c in range(width):
        crowded = (taken & (apart[:, c, :] < dist[:, c, None])).any(1)
        taken[:, c] = ~crowded & (ids[:, c] >= 0) & (taken.sum(1) < count)
    rank = np.where(ids < 0, 2 * width, np.where(taken, 0, width)) + np.arange(width)
    order = np.argsort(rank, 1)[:, :count]
    return np.take_along_axis(ids, order, 1)


def build_layer(points: np.ndarray, size: int, links: int, entry: np.ndarray) -> np.ndarray:
    """Neighbour array of the layer that holds the first ``size`` points; ``entry`` is where each one's walk starts."""
    layer = np.full((size, links), -1, np.int32)
    start = 1
    while start < size:
        end = min(size, start + min(start, STEP_QUERIES))
        new = np.arange(start, end)
        # nodes of the upper layers may not be in this one yet: then from the top
        begin = np.where(entry[new] < start, entry[new], 0)
        ids, dist = walk(points, layer[:start], points[new], begin, VIEW_BUILD)
        ids, dist = ids[:, : 3 * links], dist[:, : 3 * links]
        chosen = choose(points, ids, dist, links)
        layer[start:end, : chosen.shape[1]] = chosen
        owner, slot = np.nonzero(chosen >= 0)
        link_back(points, layer, chosen[owner, slot], new[owner])
        start = end
    return layer


def link_back(points: np.ndarray, layer: np.ndarray, nodes: np.ndarray, new: np.ndarray) -> None:
    """Adds each ``new`` node to the neighbours of its node, choosing anew where there are too many."""
    links = layer.shape[1]
    order = np.argsort(nodes, kind="stable")
    nodes, new = nodes[order], new[order]
    while len(nodes):
        first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        place = np.arange(len(nodes)) - np.repeat(first, np.diff(np.append(first, len(nodes))))
        now = place < links  # at most as many as a row has; the others take another turn
        heads = nodes[first]
        wide = np.full((len(heads), 2 * links), -1, np.int32)
        wide[:, :links] = layer[heads]
        row = np.searchsorted(heads, nodes[now])
        wide[row, links + place[now]] = new[now]
        full = (wide >= 0).sum(1) > links
        packed = np.take_along_axis(wide, np.argsort(wide < 0, 1, kind="stable"), 1)
        layer[heads[~full]] = packed[~full, :links]
        if full.any():
            ids, centre = packed[full], heads[full]
            owner, slot = np.nonzero(ids >= 0)
            dist = np.full(ids.shape, np.inf, np.float32)
            dist[owner, slot] = distances(points, ids[owner, slot], points[centre], owner)
            by = np.argsort(dist, 1, kind="stable")
            layer[centre] = choose(points, np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1), links)
        nodes, new = nodes[~now], new[~now]


class Graph:
    """Flat arrays of one shard: ids, vectors, layer sizes (lowest first) and neighbours."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sizes: list[int], layers: list[np.ndarray]):
        self.ids, self.vectors, self.sizes, self.layers = ids, vectors, sizes, layers
        norms = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
        extra = np.sqrt(np.maximum(0, norms.max() - norms)).astype(np.float32)
        self.points = np.column_stack([vectors, extra]).astype(np.float32)

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        rng = np.random.default_rng(len(ids))
        level = np.floor(-np.log(1 - rng.random(len(ids))) / math.log(LINKS)).astype(int)
        level[rng.integers(len(ids))] = level.max()
        order = np.argsort(-level, kind="stable")
        level = level[order]
        sizes = [int((level >= k).sum()) for k in range(level.max() + 1)]
        graph = cls(ids[order], vectors[order], sizes, [])
        entry, layers = np.zeros(len(ids), np.int64), []
        for k in range(len(sizes) - 1, -1, -1):
            layers.append(build_layer(graph.points, sizes[k], LINKS * (2 if k == 0 else 1), entry))
            if k:  # where the nodes of the next layer start
                low = np.arange(sizes[k], sizes[k - 1])
                for at in range(0, len(low), STEP_QUERIES):
                    part = low[at : at + STEP_QUERIES]
                    entry[low[at : at + STEP_QUERIES]] = walk(graph.points, layers[-1], graph.points[part], entry[part], 8)[0][:, 0]
                entry[sizes[k - 1] :] = 0
        graph.layers = layers[::-1]
        return graph

    def search(self, query: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the positions and inner products of the ``count`` nearest met, -1 where fewer."""
        wide = np.column_stack([query, np.zeros(len(query))]).astype(np.float32)
        entry = np.zeros(len(query), np.int64)
        for layer in self.layers[:0:-1]:
            entry = walk(self.points, layer, wide, entry, 8)[0][:, 0]
        view = min(max(VIEW_SEARCH, VIEW_PER_DIMENSION * query.shape[1], 2 * count), len(self.ids) + WIDTH)
        met = walk(self.points, self.layers[0], wide, entry, view)[0]
        exact = np.einsum("qij,qj->qi", self.vectors[met].astype(np.float64), query.astype(np.float64))
        exact = np.where(met >= 0, exact, -np.inf)
        order = np.lexsort((np.where(met >= 0, self.ids[met], 2**62), -exact))[:, :count]
        return np.take_along_axis(met, order, 1), np.take_along_axis(exact, order, 1)


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vector, dim) of the rows with an id and a vector that is not null, zero or holds null or non-finite components."""
    v = F.col(vector)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.filter(F.col(ident).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(ident).cast("long").alias("id"), v.cast("array<float>").alias("vector"), F.size(v).alias("dim"))


def build_index(nodes: DataFrame, shards: int) -> DataFrame:
    """A row per (dim, shard) with the graph's flat arrays, from nodes (id, vector, dim)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        graph = Graph.built(pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy()).astype(np.float32))
        row = {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "ids": graph.ids.tobytes(), "vectors": graph.vectors.tobytes(), "sizes": np.array(graph.sizes, np.int64).tobytes(), "neighbours": b"".join(x.tobytes() for x in graph.layers)}
        return pd.DataFrame([row])

    ship(nodes.sparkSession)
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, vectors binary, sizes binary, neighbours binary")


def loaded(row: pd.Series) -> Graph:
    sizes = np.frombuffer(row["sizes"], np.int64).tolist()
    ids, flat, layers, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["neighbours"], np.int32), [], 0
    for k, size in enumerate(sizes):
        width = LINKS * (2 if k == 0 else 1)
        layers.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(ids, np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1), sizes, layers)


def search_index(index: DataFrame, queries: DataFrame, shards: int, count: int) -> DataFrame:
    """(query_id, node, score) of the ``count`` best nodes of every shard for each of queries (id, vector, dim)."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            graph = loaded(right.iloc[0])
            for at in range(0, len(left), STEP_QUERIES):
                part = left.iloc[at : at + STEP_QUERIES]
                met, score = graph.search(np.stack(part["vector"].to_numpy()).astype(np.float32), count)
                owner, slot = np.nonzero(met >= 0)
                out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[owner], "node": graph.ids[met[owner, slot]], "score": score[owner, slot]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "node": [], "score": []})

    ship(queries.sparkSession)
    blocks = 1 + queries.count() // BLOCK_QUERIES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    held = index.withColumn("block", every(blocks))
    keys = ["dim", "shard", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "query_id long, node long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``vectors`` with the largest inner product to each query.

    A query's own row (the same id) is left out. Ties go to the smaller id. Null, zero and
    non-finite vectors and rows with a null id take no part, and only vectors of a query's
    dimension are found. Rows that share an id and vector are one; an empty table gives no rows.
    Columns beside ident and vector are not read.
    """
    rows = usable(vectors, ident, vector).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))}).distinct()
    rows = written(rows, "vectors")
    same = Window.partitionBy("dim", "h1", "h2").orderBy("id")
    # of equal vectors no more than the k + 1 smallest ids can be among k results; Spark drops the others before the shuffle
    members = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    members = written(members.select("dim", "h1", "h2", "id", "place"), "members")
    heads = members.filter("place = 1").select("dim", "h1", "h2", "id")
    nodes = written(rows.join(heads, ["dim", "h1", "h2", "id"], "left_semi").select("id", "vector", "dim"), "nodes")
    shards = 1 + nodes.count() // SHARD_ROWS
    index = written(build_index(nodes, shards), "index")
    asked = usable(queries, ident, vector).dropDuplicates(["id"])
    found = written(search_index(index, asked, shards, k + 1), "found")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
    named = members.join(heads.withColumnRenamed("id", "node"), ["dim", "h1", "h2"]).select("node", "id")
    pairs = top.join(named, "node").filter("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
