"""Approximate nearest neighbours: a vantage-point tree for each shard of the vectors, written as an index that blocks of queries meet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pstable import matrix, vectors
from .scratch import save

LEAF = 128
#: Most tasks that a search is dealt to; each takes whole shards.
MOST_TASKS = 1 << 14
#: Pruning factors to choose from.
FACTORS = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 16.0, 24.0)


def build(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and the tree's nodes (begin, end, vantage or -1, median distance, inner child, outer child) as rows.

    A node's points are order[begin:end]; its vantage point lies first, then the half within the median distance. Points that are
    all as far from it as each other stay one leaf.
    """
    order, nodes, open_ = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while open_:
        begin, end, parent, side = open_.pop()
        if parent >= 0:
            nodes[parent][4 + side] = len(nodes)
        node = [begin, end, -1, 0.0, -1, -1]
        nodes.append(node)
        if end - begin <= LEAF:
            continue
        own = order[begin:end]
        sample = rng.choice(len(own), 8, replace=False)
        probe = x[own[rng.choice(len(own), min(len(own), 32), replace=False)]]
        spread = [np.sqrt(((probe - x[own[s]]) ** 2).sum(1)).var() for s in sample]
        first = int(sample[int(np.argmax(spread))])
        own[[0, first]] = own[[first, 0]]
        d = np.sqrt(((x[own[1:]] - x[own[0]]) ** 2).sum(1))
        median = float(np.median(d))
        inner = d <= median
        if inner.all():
            inner = d < median
        if not inner.any() or inner.all():
            continue
        order[begin:end] = np.concatenate([own[:1], own[1:][inner], own[1:][~inner]])
        node[2], node[3] = int(own[0]), median
        cut = begin + 1 + int(inner.sum())
        open_ += [(begin + 1, cut, len(nodes) - 1, 0), (cut, end, len(nodes) - 1, 1)]
    return order, np.array(nodes, dtype=float)


class Nearest:
    """The k nearest found so far for each query of a block, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.square = (queries * queries).sum(1)
        self.distance = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.compared = 0

    def reach(self, q: np.ndarray) -> np.ndarray:
        return self.distance[q, -1]

    def offer(self, q: np.ndarray, points: np.ndarray, ids: np.ndarray, step: int = 1 << 21) -> None:
        """Compares the queries ``q`` with points (their ids ascending within equal points).

        A matrix product tells which queries have a point within reach, with room for its rounding; these alone take exact distances.
        """
        self.compared += len(q) * len(ids)
        square = (points * points).sum(1)
        near = self.square[q][:, None] + square - 2 * (self.queries[q] @ points.T)
        room = 1e-9 * (self.square[q][:, None] + square)
        q = q[(near - room <= (self.reach(q) ** 2)[:, None]).any(1)]
        rows = max(1, step // max(1, points.size))
        for start in range(0, len(q), rows):
            some = q[start : start + rows]
            d = np.sqrt(((self.queries[some][:, None, :] - points[None]) ** 2).sum(2))
            d[self.ids[some][:, None] == ids[None]] = np.inf
            every = np.concatenate([self.distance[some], d], axis=1)
            names = np.concatenate([self.found[some], np.broadcast_to(ids, d.shape)], axis=1)
            best = np.lexsort((names, every), axis=1)[:, : self.k]
            self.distance[some] = np.take_along_axis(every, best, 1)
            self.found[some] = np.take_along_axis(names, best, 1)


def search(x: np.ndarray, ids: np.ndarray, order: np.ndarray, nodes: np.ndarray, near: Nearest, factor: float) -> None:
    """Searches one tree for a block of queries. A query leaves a side out if |d - median| * factor exceeds its k-th distance so far;
    at factor one that is the triangle inequality, and the result is exact."""
    steps = [(0, np.arange(len(near.ids)), None)]
    while steps:
        node, q, gap = steps.pop()
        if gap is not None:
            stays = gap * factor <= near.reach(q)
            q = q[stays]
        if not len(q):
            continue
        begin, end, vantage, median, inner, outer = nodes[node]
        if vantage < 0:
            own = order[int(begin) : int(end)]
            near.offer(q, x[own], ids[own])
            continue
        point = int(vantage)
        d = np.sqrt(((near.queries[q] - x[point]) ** 2).sum(1))
        near.offer(q, x[point : point + 1], ids[point : point + 1])
        gap = np.abs(d - median)
        inside = d <= median
        # last in, first out: each query's own side comes before its far side
        steps += [(int(outer), q[inside], gap[inside]), (int(inner), q[~inside], gap[~inside]), (int(inner), q[inside], None), (int(outer), q[~inside], None)]


def build_index(df: DataFrame, key: str, column: str, shard_rows: int, seed: int = 42) -> DataFrame:
    """(shard, dim, ids, vecs, order, nodes) of every vector with a direction, by shards of about ``shard_rows`` dealt by a hash of the id."""
    points = vectors(df, key, column)
    shards = max(1, -(-points.count() // shard_rows))
    points = points.select("id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def trees(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = matrix(rows.column("vec").combine_chunks())
        order, nodes = build(x, np.random.default_rng([seed, group[0].as_py()]))
        one = {"shard": group[0].as_py(), "dim": group[1].as_py(), "ids": rows.column("id").to_numpy().tobytes(), "vecs": x.tobytes(), "order": order.tobytes(), "nodes": nodes.tobytes()}
        return pa.Table.from_pylist([one], pa.schema([("shard", pa.int32()), ("dim", pa.int32())] + [(c, pa.binary()) for c in ("ids", "vecs", "order", "nodes")]))

    return save(points.groupBy("shard", "dim").applyInArrow(trees, "shard int, dim int, ids binary, vecs binary, order binary, nodes binary"), "vptrees")


def share_found(x: np.ndarray, ids: np.ndarray, order: np.ndarray, nodes: np.ndarray, asked: np.ndarray, exact: np.ndarray, factor: float) -> tuple[float, float]:
    """Recall of a tree's search for some of its own points, against their ``exact`` nearest, and the share of points compared."""
    near = Nearest(x[asked], ids[asked], exact.shape[1])
    search(x, ids, order, nodes, near, factor)
    hits = sum(len(np.intersect1d(a, b)) for a, b in zip(near.found, exact, strict=True))
    return hits / max(1, len(asked) * min(exact.shape[1], len(ids) - 1)), near.compared / max(1, len(asked) * len(ids))


def sample_factor(index: DataFrame, k: int, recall: float, sample: int = 128, seed: int = 42) -> float:
    """The greatest of ``FACTORS`` at which ``sample`` points of one shard keep ``recall`` of their nearest in it; a sample of fixed size.

    Other shards hold farther points for a query, so they prune less, and the whole search finds at least about as much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.to_pylist():
                ids, order, nodes = np.frombuffer(tree["ids"], np.int64), np.frombuffer(tree["order"], np.int64), np.frombuffer(tree["nodes"], np.float64).reshape(-1, 6)
                x = np.frombuffer(tree["vecs"], np.float64).reshape(len(ids), -1)
                asked = np.random.default_rng(seed).permutation(len(ids))[:sample]
                whole = Nearest(x[asked], ids[asked], k)
                whole.offer(np.arange(len(asked)), x, ids)
                good = takewhile(lambda f: share_found(x, ids, order, nodes, asked, whole.found, f)[0] >= recall, FACTORS)
                yield pa.RecordBatch.from_arrays([pa.array([max(good, default=1.0)], pa.float64())], ["factor"])

    first = index.orderBy("shard", "dim").limit(1).mapInArrow(run, "factor double").first()
    return first.factor if first else 1.0


def nearest(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 10, factor: float | None = None, recall: float = 0.98, shard_rows: int = 4096, block_rows: int = 2048, seed: int = 42
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``df`` found, itself left out, by Euclidean distance.

    ``factor`` >= 1 prunes harder than the triangle inequality allows; 1 gives the exact result, None takes the greatest that keeps ``recall``
    on a sample. Vectors null, zero or holding null or non-finite components take no part; vectors are compared with those of their
    own length. Queries are packed into blocks of about ``block_rows``, which Spark moves to every shard; nothing is broadcast or
    collected. Ties go to the smaller id; rows repeated under an id are candidates each; extra columns are ignored; an empty table
    gives an empty one.
    """
    index = build_index(df, key, column, shard_rows, seed)
    factor = sample_factor(index, k, recall, seed=seed) if factor is None else factor
    asked = vectors(queries, key, column)
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks))).withColumn("dim", F.size("vec"))

    def packed(group: tuple, rows: pa.Table) -> pa.Table:
        vecs = matrix(rows.column("vec").combine_chunks())
        return pa.table({"dim": pa.array([group[1].as_py()], pa.int32()), "names": pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()), "asked": pa.array([vecs.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids, names = np.frombuffer(tree["ids"], np.int64), np.frombuffer(tree["names"], np.int64)
                x = np.frombuffer(tree["vecs"], np.float64).reshape(len(ids), -1)
                near = Nearest(np.frombuffer(tree["asked"], np.float64).reshape(len(names), -1), names, k)
                search(x, ids, np.frombuffer(tree["order"], np.int64), np.frombuffer(tree["nodes"], np.float64).reshape(-1, 6), near, factor)
                q, r = np.nonzero(np.isfinite(near.distance))
                yield pa.RecordBatch.from_arrays([pa.array(near.ids[q]), pa.array(near.found[q, r]), pa.array(near.distance[q, r])], ["query_id", "vec_id", "score"])

    shards = index.agg(F.max("shard")).first()[0]
    asked = save(asked.groupBy("block", "dim").applyInArrow(packed, "dim int, names binary, asked binary"), "queries")
    spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))
    # a number of its own, since adaptive execution would put small shards into one task, and the work is in the comparing
    met = index.repartition(min((shards or 0) + 1, MOST_TASKS), "shard", "dim").join(spread.hint("merge"), ["shard", "dim"])
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
