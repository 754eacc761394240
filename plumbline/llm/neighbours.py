"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard (operator 12)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, stored


@dataclass(frozen=True)
class GraphParams:
    #: Neighbours of a query.
    k: int = 20
    #: Edges that leave a node.
    degree: int = 40
    #: Nodes that a search keeps: while the graph grows, and for queries.
    build_beam: int = 80
    beam: int = 160
    #: An edge is dropped if a kept one's end is nearer to its end by this factor.
    alpha: float = 1.15
    #: Components in a shard's distinct vectors, and in a block of queries; a task holds one of each.
    shard_values: int = 1 << 19
    query_values: int = 1 << 18
    seed: int = 7


#: Points that are searched at once, and nodes that each search opens in a step.
TOGETHER, OPENED = 256, 4


class Graph:
    """Points, and for each the places of its neighbours (-1: none).

    The largest inner product is the least distance once every point gets a
    component more that makes all as long as the longest, and queries get 0.
    """

    def __init__(self, points: np.ndarray, edges: np.ndarray | None, params: GraphParams):
        self.params = params
        flat = points.astype(np.float32)
        # no vector is longer than 1 afterwards, so float32 can square any of them
        self.scale = 1 / max(np.sqrt((flat.astype(np.float64) ** 2).sum(1).max(initial=0)), 1e-300)
        flat = (flat * self.scale).astype(np.float32)
        rest = np.sqrt(np.maximum(1 - (flat.astype(np.float64) ** 2).sum(1), 0))
        self.points = np.concatenate([flat, rest[:, None].astype(np.float32)], 1)
        self.edges = np.full((len(points), params.degree), -1, np.int32) if edges is None else edges
        centre = self.points.mean(0) if len(points) else np.zeros(self.points.shape[1], np.float32)
        # searches begin at the node next to the centre and at some others, spread over the shard
        spread = np.random.default_rng(params.seed).permutation(len(points))[:15]
        self.begin = np.unique(np.append(spread, np.argmin(((self.points - centre) ** 2).sum(1)))) if len(points) else spread

    def distance(self, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distance of each query (all as long as 1, or less) to its own row of places, but for the query's own square."""
        near = self.points[places]
        return 1 - 2 * np.matmul(near, queries[:, :, None])[:, :, 0]

    def search(self, queries: np.ndarray, beam: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beam that each query ends with, by distance: places (-1: none), distances, and all places it opened.

        Greedy: in each step every query opens the nearest nodes of its beam that
        it has not opened yet, until there are none.
        """
        many, nodes = len(queries), len(self.points)
        beam = min(beam, nodes)
        seen = np.zeros((many, nodes + 1), bool)
        seen[:, -1] = True
        at = np.full((many, beam), nodes, np.int64)
        far = np.full((many, beam), np.inf, np.float32)
        opened = np.ones((many, beam), bool)
        start = np.broadcast_to(begin[:beam], (many, min(len(begin), beam)))
        at[:, : start.shape[1]], far[:, : start.shape[1]], opened[:, : start.shape[1]] = start, self.distance(queries, start), False
        np.put_along_axis(seen, start, True, 1)
        order = np.argsort(far, 1)
        at, far, opened = (np.take_along_axis(x, order, 1) for x in (at, far, opened))
        visited: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(many)
        while True:
            todo = ~opened[live]
            live = live[todo.any(1)]
            if not len(live):
                break
            todo = ~opened[live]
            todo &= np.cumsum(todo, 1) <= OPENED
            row, column = np.nonzero(todo)
            opened[live[row], column] = True
            place = at[live[row], column]
            visited.append((live[row], place))
            new = np.full((len(live), OPENED, self.edges.shape[1]), nodes, np.int64)
            rank = np.cumsum(todo, 1)[row, column] - 1
            new[row, rank] = self.edges[place]
            new = new.reshape(len(live), -1)
            new[new < 0] = nodes
            # each place once a query: seen before, or earlier in this row
            new.sort(axis=1)
            known = seen[live[:, None], new]
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            new[known] = nodes
            new.sort(axis=1)
            width = int((new < nodes).sum(1).max(initial=0))
            if not width:
                continue
            new = new[:, :width]
            seen[live[:, None], new] = True
            there = new < nodes
            gap = self.distance(queries[live], np.minimum(new, nodes - 1))
            gap[~there] = np.inf
            all_at = np.concatenate([at[live], new], 1)
            all_far = np.concatenate([far[live], gap], 1)
            all_opened = np.concatenate([opened[live], ~there], 1)
            order = np.argpartition(all_far, beam - 1, 1)[:, :beam]
            part = np.take_along_axis(all_far, order, 1)
            order = np.take_along_axis(order, np.argsort(part, 1), 1)
            at[live], far[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_at, all_far, all_opened))
        at[np.isinf(far)] = -1
        rows, places = (np.concatenate(x) for x in zip(*visited, strict=True)) if visited else (np.zeros(0, np.int64),) * 2
        return at, far, np.stack([rows, places])

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Edges for each node from its row of candidates (-1: none; no place twice).

        The nearest candidate is kept; those that lie nearer to it than to the
        node, by the factor alpha, go; then the nearest that is left, and so on.
        """
        alive = (candidates >= 0) & (candidates != nodes[:, None])
        place = np.maximum(candidates, 0)
        own, near = self.points[nodes], self.points[place]
        square = (self.points * self.points).sum(1)
        far = square[nodes][:, None] + square[place] - 2 * np.matmul(near, own[:, :, None])[:, :, 0]
        between = square[place][:, :, None] + square[place][:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
        far, between = np.maximum(far, 0), np.maximum(between, 0)
        factor = self.params.alpha**2
        kept = np.full((len(nodes), self.params.degree), -1, np.int32)
        row = np.arange(len(nodes))
        for k in range(self.params.degree):
            best = np.argmin(np.where(alive, far, np.inf), 1)
            there = alive[row, best]
            if not there.any():
                break
            kept[there, k] = place[row, best][there]
            alive &= factor * between[row, best] > far
            alive[row, best] = False
        return kept

    def build(self) -> None:
        """Adds the points in random order, each batch no larger than a part of what is there, and links both ways."""
        params, n = self.params, len(self.points)
        order = np.random.default_rng(params.seed + 1).permutation(n)
        order = np.concatenate([self.begin, order[~np.isin(order, self.begin)]])
        done = min(n, params.degree + 1)
        # the first nodes know each other
        first = order[:done]
        for k in first.tolist():
            self.edges[k, : done - 1] = first[first != k]
        while done < n:
            some = order[done : done + min(max(done // 2, 1), TOGETHER)]
            done += len(some)
            queries = self.points[some]
            at, _, (rows, places) = self.search(queries, params.build_beam, self.begin)
            found = padded(np.concatenate([np.repeat(np.arange(len(some)), at.shape[1]), rows]), np.concatenate([at.ravel(), places]), len(some))
            self.edges[some] = kept = self.prune(some, found)
            self.link_back(np.repeat(some, kept.shape[1]), kept.ravel())

    def link_back(self, source: np.ndarray, target: np.ndarray) -> None:
        """An edge from each target to its source; a node with more edges than it may have is pruned again."""
        source, target = source[target >= 0], target[target >= 0].astype(np.int64)
        while len(target):
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, first, many = np.unique(target, return_index=True, return_counts=True)
            rank = np.arange(len(target)) - np.repeat(first, many)
            now = rank < self.params.degree  # what a node gets more comes in the next round
            of = np.repeat(np.arange(len(nodes)), many)[now]
            old = self.edges[nodes]
            wide = padded(np.concatenate([np.repeat(np.arange(len(nodes)), old.shape[1]), of]), np.concatenate([old.ravel(), source[now]]), len(nodes))
            fits = (wide >= 0).sum(1) <= self.params.degree
            plain = np.full((len(nodes), self.params.degree), -1, np.int32)
            width = min(wide.shape[1], self.params.degree)
            plain[:, :width] = wide[:, :width]
            full = np.flatnonzero(~fits)
            for k in range(0, len(full), TOGETHER):
                plain[full[k : k + TOGETHER]] = self.prune(nodes[full[k : k + TOGETHER]], wide[full[k : k + TOGETHER]])
            self.edges[nodes] = plain
            source, target = source[~now], target[~now]


def padded(row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """The distinct places (from 0 on) of each row, side by side, filled up with -1."""
    key = np.unique(row[place >= 0].astype(np.int64) << 32 | place[place >= 0].astype(np.int64))
    row, place = key >> 32, key & 0xFFFFFFFF
    many = np.bincount(row, minlength=rows)
    out = np.full((rows, max(int(many.max(initial=0)), 1)), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = place
    return out


def matrix(lists: pa.ChunkedArray | pa.Array, width: int, kind) -> np.ndarray:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


def usable(rows: DataFrame) -> DataFrame:
    """The rows with an id and a vector of finite components that are not all 0, with `dims`."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .where(~bad & F.exists("vector", lambda x: x != 0))
        .withColumn("dims", F.size("vector"))
    )


def build_graphs(rows: DataFrame, params: GraphParams, store: Callable[[DataFrame, str], DataFrame] = stored) -> tuple[DataFrame, int]:
    """The index of rows with columns id and vector: (dims, shard, place, ids, vector, edges) as `store` keeps it, and its number of shards.

    Equal vectors are one node with their smallest k + 1 ids: of equal scores
    the smaller ids come first, so no result can have others (k, and the query
    itself). Spark keeps no more of a vector in each task before it shuffles.
    Nodes are dealt to shards of bounded size by the hash of their vectors.
    """
    good = usable(rows)
    least = good.distinct().withColumn("rank__", F.row_number().over(Window.partitionBy("dims", "vector").orderBy("id"))).where(F.col("rank__") <= params.k + 1)
    nodes = least.groupBy("dims", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    with Tables(rows.sparkSession) as t:
        nodes = t.stored(nodes, "nodes")
        size = nodes.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
        shards = -(-size.n * (size.dims or 1) // params.shard_values) or 1

        def plant(t: pa.Table) -> pa.Table:
            dims = t.column("dims")[0].as_py()
            graph = Graph(matrix(t.column("vector"), dims, np.float64), None, params)
            graph.build()
            edges = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * params.degree, pa.int32()), pa.array(graph.edges.ravel(), pa.int32()))
            return pa.table({"dims": t.column("dims"), "shard": t.column("shard"), "place": pa.array(range(len(t)), pa.int32()), "ids": t.column("ids"), "vector": t.column("vector"), "edges": edges})

        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
        graphs = dealt.groupBy("dims", "shard").applyInArrow(plant, "dims int, shard int, place int, ids array<long>, vector array<double>, edges array<int>")
        return store(graphs, "graphs"), shards


def nearest(queries: DataFrame, graphs: DataFrame, shards: int, params: GraphParams) -> DataFrame:
    """query_id, rank, id, score: the k nearest of each query (columns id and vector) that beam searches of all shards find.

    Each pair of a shard and a block of queries is one task's work, which gives
    k rows a query; these are merged. Scores are inner products in double
    precision of the vectors as they are. Nearest first, ties by smaller id; a
    query's own id is left out. A query finds vectors of its own length only.
    """
    asked = usable(queries).distinct()
    size = asked.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    blocks = -(-size.n * (size.dims or 1) // params.query_values) or 1
    keys = ["dims", "shard", "block"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")).withColumn("query", F.xxhash64("vector"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            right = right.sort_by("place")
            dims = left.column("dims")[0].as_py()
            exact = matrix(right.column("vector"), dims, np.float64)
            graph = Graph(exact, matrix(right.column("edges"), params.degree, np.int32), params)
            listed = right.column("ids").combine_chunks()
            ids, first = listed.flatten().to_numpy(), listed.offsets.to_numpy()
            first = first - first[0]
            query, own, number = matrix(left.column("vector"), dims, np.float64), left.column("id").to_numpy(), left.column("query").to_numpy()
            for k in range(0, len(query), TOGETHER):
                some = query[k : k + TOGETHER]
                unit = some / np.abs(some).max(1)[:, None]
                unit /= np.sqrt((unit * unit).sum(1))[:, None]
                at, _, _ = graph.search(np.concatenate([unit, np.zeros((len(some), 1))], 1).astype(np.float32), params.beam, graph.begin)
                row, column = np.nonzero(at >= 0)
                place = at[row, column]
                score = np.einsum("ij,ij->i", some[row], exact[place])
                many = first[place + 1] - first[place]
                row, score = np.repeat(row, many), np.repeat(score, many)
                other = ids[np.repeat(first[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                keep = other != own[k + row]
                row, other, score = row[keep], other[keep], score[keep]
                order = np.lexsort((other, -score, row))
                row, other, score = row[order], other[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank < params.k
                out.append((own[k + row[best]], number[k + row[best]], other[best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "query", "id", "score"), columns, strict=True)))

    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_id long, query long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", "id", "score")


def neighbours(rows: DataFrame, queries: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, id, score: the k nearest of `rows` for each of `queries` (both with columns id and vector), approximately.

    Rows with a null id, a null or zero vector, or a component that is null or
    not finite take no part, on either side. Rows that repeat id and vector count
    once; equal vectors of several ids tie, and smaller ids come first. Other
    columns are ignored; empty tables give no rows. All rows are in the index.
    """
    with Tables(rows.sparkSession) as t:
        graphs, shards = build_graphs(rows, params, t.stored)
        return stored(nearest(queries, graphs, shards, params), "neighbours")
