"""Vectorised tokenising of Arrow text columns: word spans and 64-bit word hashes with a few numpy passes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes that end a word: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
INSIDE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Powers of the base are products of one from each of two short tables, whatever the place: of 0 to STEP - 1 and of multiples of STEP.
STEP = 1 << 12


class Powers:
    def __init__(self, base: np.uint64):
        self.low = self._first(base, STEP)
        self.base, self.high = (self.low[-1:] * base)[0], np.ones(1, np.uint64)

    @staticmethod
    def _first(base: np.uint64, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def upto(self, n: int) -> np.ndarray:
        """The powers of multiples of STEP, as many as places below ``n`` need."""
        if len(self.high) <= n // STEP:
            self.high = self._first(self.base, n // STEP + 256)
        return self.high

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.upto(int(place.max(initial=0)) + 1)[place >> 12] * self.low[place & (STEP - 1)]


_up, _down = Powers(_BASE), Powers(_BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, from 0; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each (a longer text stands alone), to bound memory."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    give_back()


def give_back() -> None:
    """Workers outlive their tasks: what a batch or a group has left free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(merge: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``merge`` of a group for applyInArrow, after which what it held goes back."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        out = merge(group, rows)
        give_back()
        return out

    return run


class Words:
    """The words of some texts: ``start`` and ``end`` of each in ``data``, ``doc`` it is in, ``count`` by document."""

    def __init__(self, column: pa.Array, lower: bool = True, breaks: str | None = None):
        data, offsets = utf8(column)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside, n = INSIDE[data], len(data)
        start, end = inside.copy(), inside.copy()
        np.greater(inside[1:], inside[:-1], out=start[1:])
        np.greater(inside[:-1], inside[1:], out=end[:-1])
        heads, tails = offsets[offsets < n], offsets[offsets > 0] - 1  # words end with their text
        start[heads], end[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(column)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    own, whole = total[1:], len(data) // STEP
    np.add(data, np.uint64(1), out=own)  # all in place: it has eight times the texts' size
    high = _up.upto(len(data) + 1)
    rows, rest = own[: whole * STEP].reshape(whole, STEP), own[whole * STEP :]
    rows *= _up.low
    rows *= high[:whole, None]
    rest *= _up.low[: len(rest)] * high[whole]
    np.cumsum(own, out=own)
    return total


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges, from prefix sums of a polynomial (``total``, if at hand): the cost doesn't depend on the lengths."""
    total = prefix_sums(data) if total is None else total
    h = total[end]
    h -= total[start]
    h *= _down.at(start)
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


class Lookup:
    """Places of 64-bit hashes in a sorted array of them: a table by leading bits leads to the few that share these."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.shift = np.uint64(64 - max(8, len(names).bit_length() + 3))
        self.begin = np.searchsorted(names >> self.shift, np.arange(1 << int(64 - self.shift), dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin, append=len(names)).max(initial=0))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place, and whether it is there."""
        at = self.begin[key >> self.shift].astype(np.int64)
        if not len(self.names):
            return at, np.zeros(len(key), bool)
        at = np.minimum(at, len(self.names) - 1)
        found = self.names[at] == key
        left = np.flatnonzero(~found)
        for k in range(1, self.most):
            place = at[left] + k
            left, place = left[place < len(self.names)], place[place < len(self.names)]
            hit = self.names[place] == key[left]
            at[left[hit]], found[left[hit]] = place[hit], True
            left = left[~hit]
        return at, found
