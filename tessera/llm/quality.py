"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network with calibrated probabilities.

Every word (letter case and marks included) has a fixed sparse ternary index vector, made from its hash. A word's vector is the sum, over the
corpus, of the index vectors of its neighbours and of its own shape (case, marks, digits, whether it repeats the word before), scaled to
unit length. Sums are kept by hash in a table of ``ENTRIES`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learn import SENT, Adam, class_rate, fold, labelled_sample, sigmoid, sum_tables, temperature
from .scratch import unused
from .tokens import Words, mix, slices

ENTRIES, SLICE, DIM, NONZERO = 1 << 16, 256, 48, 6
#: Words whose vectors are gathered at once.
BLOCK = 1 << 14

_UPPER, _LOWER, _DIGIT, _MARK = ((np.isin(np.arange(256), np.frombuffer(chars, np.uint8))) for chars in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A number under 48 for each word's case, marks, digits, and whether it repeats the word before."""
    sums = [np.concatenate([[0], np.cumsum(kind[words.data])]) for kind in (_UPPER, _LOWER, _DIGIT, _MARK)]
    upper, lower, digit, mark = (s[words.end] - s[words.start] for s in sums)
    case = np.where((upper > 0) & (lower == 0), 2, np.where(upper > 0, 1, 0))  # 2: no small letters
    case = np.where((upper == 0) & (lower == 0), 3, case)
    marks = np.where(mark >= 2, 2, np.minimum(mark, 1))
    repeats = np.zeros(len(hashes), np.int64)
    if len(hashes) > 1:
        repeats[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return ((case * 3 + marks) * 2 + repeats) * 2 + (digit > 0)


def index_vectors(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(NONZERO, keys): places and signs of the entries of each key's index vector."""
    salt = np.arange(1, NONZERO + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = mix(keys[None, :] + salt)
    return ((x >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64), np.where(x & np.uint64(1), 1.0, -1.0)


def word_vectors(docs: DataFrame, seed: int) -> np.ndarray:
    """(ENTRIES, DIM) unit vectors from the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ENTRIES * DIM, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=False)
                h = words.hashes()
                if not len(h):
                    continue
                to = (h % np.uint64(ENTRIES)).astype(np.int64) * DIM
                together = np.flatnonzero(words.doc[1:] == words.doc[:-1])
                every = np.arange(len(h))
                context = [(together, together + 1, h), (together + 1, together, h), (every, every, ~shapes(words, h).astype(np.uint64))]
                for own, other, keys in context:
                    names, inverse = np.unique(keys, return_inverse=True)
                    row, key = to[own], inverse[other]
                    place, sign = index_vectors(names, seed)
                    for p, s in zip(place, sign.astype(np.int32), strict=True):
                        np.add.at(table, row + p[key], s[key])  # in place: the table is far larger than a part's words
        blocks = table.reshape(ENTRIES // SLICE, -1)
        some = np.flatnonzero(blocks.any(1))
        salt = TaskContext.get().partitionId()
        for few in np.array_split(some, -(-len(some) // SENT)) if len(some) else ():
            yield pa.RecordBatch.from_arrays([pa.array(few.astype(np.int32)), pa.array([salt] * len(few), pa.int32()), pa.array([blocks[b].tobytes() for b in few])], ["slice", "salt", "cells"])

    total = np.zeros((ENTRIES // SLICE, SLICE * DIM))
    for at, cells in sum_tables(docs.select(F.col("text").cast("string")).mapInArrow(run, "slice int, salt int, cells binary"), np.int32):
        total[at] = cells
    total = total.reshape(-1, DIM)
    return (total / np.maximum(np.sqrt((total * total).sum(1)), 1e-12)[:, None]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Each text's mean word vector, with the log of its number of words."""
    words = Words(column, lower=False)
    own = (words.hashes() % np.uint64(ENTRIES)).astype(np.int64)
    out = np.zeros((len(column), DIM + 1))
    some = np.flatnonzero(words.count)
    first, end = words.first[some], words.first[some + 1]
    k = 0
    while k < len(some):
        to = max(k + 1, int(np.searchsorted(end, first[k] + BLOCK, "right")))
        if end[to - 1] - first[k] <= BLOCK:
            out[some[k:to], :DIM] = np.add.reduceat(vectors[own[first[k] : end[to - 1]]], first[k:to] - first[k], axis=0, dtype=np.float64)
        else:  # a long text alone
            for at in range(first[k], end[k], BLOCK):
                out[some[k], :DIM] += vectors[own[at : min(at + BLOCK, end[k])]].sum(0, dtype=np.float64)
        k = to
    out[some, :DIM] /= words.count[some, None]
    out[:, DIM] = np.log1p(words.count) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``scores`` are probabilities at the calibrated temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    heat: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.heat)


def train(x: np.ndarray, y: np.ndarray, rate: float, hidden: int = 32, epochs: int = 120, seed: int = 42) -> Network:
    """Fits on four fifths of the rows, weighted so that label 1 has the share ``rate``, and the temperature on the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    ones = max(y.mean(), 1e-9) if len(y) else 0.5
    weight = np.where(y == 1, rate / ones, (1 - rate) / max(1 - ones, 1e-9))
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(DIM + 1), np.ones(DIM + 1), np.zeros((DIM + 1, 1)), np.zeros(1), np.zeros(1), np.array([np.log(rate / (1 - rate))]), 1.0)
    cut = len(y) * 4 // 5
    net = Network(x[:cut].mean(0), x[:cut].std(0) + 1e-6, rng.normal(0, 0.2, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(1), 1.0)
    adam = Adam([net.w1, net.b1, net.w2, net.b2], 0.01)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(cut), max(1, cut // 256)):
            z = (x[rows] - net.mean) / net.scale
            a = np.tanh(z @ net.w1 + net.b1)
            g = weight[rows] * (sigmoid(a @ net.w2 + net.b2[0]) - y[rows]) / len(rows)
            back = np.outer(g, net.w2) * (1 - a * a)
            adam.step([z.T @ back + 1e-4 * net.w1, back.sum(0), a.T @ g + 1e-4 * net.w2, np.array([g.sum()])])
    if cut < len(y) and y[cut:].min() < y[cut:].max():
        net.heat = temperature(net.logits(x[cut:]), y[cut:], weight[cut:])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, seed: int = 42) -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs`` and the network, fitted on a sample of at most ``per_class`` labelled rows a class."""
    vectors = word_vectors(docs, seed)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(part.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    sample = labelled_sample(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, "quality", per_class, 3, 1)
    rows = sample.mapInArrow(run, "doc_id long, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    x = np.stack([np.frombuffer(r.x) for r in rows]) if rows else np.zeros((0, DIM + 1))
    return vectors, train(x, np.array([r.label for r in rows], dtype=float), class_rate(labels, "quality", 3, 1), seed=seed)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 6000, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted.

    score is the probability that the quality label is 1, from the text alone; null and empty texts get the network's score of no words.
    Labels of the held-out fold (crc32 of the id modulo 3 is 1) are never read; of contradicting labels of one id the greater counts, and
    of repeated rows of a labelled id one, the same in every run. Without labelled rows of both classes every score is
    the prior. Repeated rows are scored each; columns named like the new ones are replaced. An empty table gives an empty one.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, seed))
    kept = docs.drop("held_out", "score", "predicted")
    (text,) = unused(kept.columns, "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = fitted.value
        for batch in batches:
            for part in slices(batch, text, 1 << 19):
                score = net.scores(pooled(part.column(text), vectors))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], "score"])

    scored = kept.withColumn(text, F.col("text").cast("string")).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", fold("doc_id", 3) == 1).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
