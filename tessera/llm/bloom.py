"""A Bloom filter over long keys: built by slices in tasks, broadcast to narrow what later passes move.

It has 32 bits for each key, counted before, up to a size that is a parameter, so what is broadcast is bounded. It only saves work: a key it
wrongly reports costs time, never a result, so keys beyond that size are no error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import mix

SLICES = 64
#: Bits of the filter for each key.
BITS = 32


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words  # (SLICES, words of each)

    def spots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(key)
        mask = np.zeros(len(x), np.uint64)
        for k in range(4):
            mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
        return ((x >> np.uint64(32)) * np.uint64(self.words.shape[1]) >> np.uint64(32)).astype(np.int64), mask

    def add(self, key: np.ndarray) -> None:
        at, mask = self.spots(key)
        np.bitwise_or.at(self.words, ((key % np.uint64(SLICES)).astype(np.int64), at), mask)

    def has(self, key: np.ndarray) -> np.ndarray:
        at, mask = self.spots(key)
        return (self.words[(key % np.uint64(SLICES)).astype(np.int64), at] & mask) == mask


def bloom_filter(keys: DataFrame, megabytes: int = 64, count: int | None = None) -> Bloom:
    """The filter of the long column ``key``, of at most ``megabytes``; ``count`` is the number of keys or somewhat more, if that is known."""
    words = max(1, min(megabytes << 17, max(1 << 14, (keys.count() if count is None else count) * BITS // 64)) // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Bloom] = {}
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            for s in np.unique(key % np.uint64(SLICES)).tolist():
                if s not in own:
                    own[s] = Bloom(np.zeros((1, words), np.uint64))
                some = key[key % np.uint64(SLICES) == s]
                at, mask = own[s].spots(some)
                np.bitwise_or.at(own[s].words[0], at, mask)
        for s, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.words.tobytes()])], ["slice", "words"])

    keys = keys.where("key is not null").select("key", F.col("key").bitwiseAND(F.lit(SLICES - 1)).alias("slice")).distinct()
    out = Bloom(np.zeros((SLICES, words), np.uint64))
    for row in keys.repartition(SLICES, "slice").mapInArrow(run, "slice int, words binary").collect():
        out.words[row.slice] |= np.frombuffer(row.words, np.uint64)
    return out
