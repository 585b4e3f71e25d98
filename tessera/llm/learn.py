"""Shared parts of the classifiers: bounded labelled samples, sums of tables over partitions, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of a table in a batch that leaves a task.
SENT = 16


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def usable_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label): labels 0 and 1 outside the held-out fold, one for each id; of contradicting ones the greater."""
    some = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    return some.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held_out: int) -> DataFrame:
    """``docs`` with label: at most ``per_class`` labelled rows of each class, in hash order, none from the held-out fold.

    Only the chosen ids, bounded by that parameter, are broadcast; texts are not shuffled. Labels other than 0 and 1 don't count; of
    contradicting ones the greater does.
    """
    usable = usable_labels(labels, label, folds, held_out)
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.join(F.broadcast(chosen), "doc_id")


def class_rate(labels: DataFrame, label: str, folds: int, held_out: int) -> float:
    """The share of label 1 over all labelled rows that may be learned from."""
    n, ones = usable_labels(labels, label, folds, held_out).agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return (ones + 1) / (n + 2)


def sum_tables(parts: DataFrame, kind: type, salts: int = 32) -> list[tuple[int, np.ndarray]]:
    """(slice, cells): the sums of tables that tasks emit as (slice int, salt int, cells binary of ``kind``), collected on the driver.

    The tables' size is a parameter of the model, not of the data. Sums are made in two rounds, so no task gets all partitions' slices;
    they leave a task as doubles.
    """

    def add(key: tuple[str, ...], kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                rows, cells = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True)), batch.column("cells")
                for k, value in zip(rows, cells, strict=True):
                    if k not in sums:
                        sums[k] = np.zeros(len(value.as_buffer()) // np.dtype(kind).itemsize)
                    sums[k] += np.frombuffer(value.as_buffer(), kind)
            keys = list(sums)
            for at in range(0, len(keys), SENT):
                few = keys[at : at + SENT]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in few], pa.int32()), pa.array([0] * len(few), pa.int32()), pa.array([sums.pop(k).tobytes() for k in few])], ["slice", "salt", "cells"])

        return run

    schema = "slice int, salt int, cells binary"
    once = parts.withColumn("salt", F.pmod("salt", F.lit(salts))).repartition("slice", "salt").mapInArrow(add(("slice", "salt"), kind), schema)
    rows = once.repartition("slice").mapInArrow(add(("slice",), np.float64), schema).select("slice", "cells").collect()
    return [(r.slice, np.frombuffer(r.cells)) for r in rows]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps for a list of arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def temperature(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted log loss, searched on a fixed grid."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [-(weight * np.log(np.clip(np.where(label == 1, p := sigmoid(logit / t), 1 - p), 1e-12, 1))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])
