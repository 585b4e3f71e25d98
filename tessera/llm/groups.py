"""Splitting of hot groups for joins of a group with itself, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save

#: Rows of hot-group tables that may be broadcast: at most this many of about 20 bytes.
BROADCAST_ROWS = 50_000


def cells(df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Deals each group's rows into cells in which every pair of the group's rows meets.

    A group of up to ``most`` rows is one cell. A larger one is cut into chunks by a hash of ``member``; the row goes to
    a cell for each pair of chunks that its own is in. Adds ``cell`` (long), ``chunk``, ``left`` and ``right`` (int): a pair of one
    chunk belongs to the cell where left = right. ``df`` is read twice; it should be a written table.
    """
    hot = save(
        df.groupBy(group).count().where(F.col("count") > most).select(group, F.ceil(F.col("count") / most).cast("int").alias("n_chunks")), "hot"
    )
    n = hot.count()
    if not n:
        drop(hot)
        cut = df.withColumn("n_chunks", F.lit(1))
    elif n <= BROADCAST_ROWS:
        cut = df.join(F.broadcast(hot), group, "left")
    else:
        cut = df.join(hot, group, "left")
    cut = cut.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), member), F.col("n_chunks")).cast("int"))
    other = F.when(F.col("n_chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    return (
        cut.withColumn("other", F.explode(other))
        .withColumn("left", F.least("chunk", "other"))
        .withColumn("right", F.greatest("chunk", "other"))
        .withColumn("cell", F.xxhash64(group, "left", "right"))
        .drop("other", "n_chunks")
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes with links a-b, the smallest node each reaches."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        different = x != y
        a, b, x, y = a[different], b[different], x[different], y[different]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the smallest node reachable.

    Rounds of taking the smallest label among neighbours, then the label's label; every round is written, and rounds end when no label
    changed. Edges and labels stay distributed; the driver sees only the number of changes.
    """
    e = save(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = save(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = save(step.join(target, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("changed")), "labels")
        drop(labels)
        labels = new
        if not labels.where("changed").limit(1).count():
            drop(e)
            return labels.select("node", F.col("label").alias("component"))
