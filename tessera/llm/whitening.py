"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers x. One pass sums them by dimension; each further pass computes Xᵀ(XQ) of the centred rows for a block Q of
orthonormal columns, as sums of small blocks over tasks, and the covariance itself is never formed. The driver holds d x (a few blocks) numbers:
it orthonormalises the new directions by QR and takes the Ritz pairs of all blocks kept (Rayleigh-Ritz), until the residuals of all k pairs are
at rounding level. Old blocks are kept with their products, which are linear, so they cost no pass; when too many are kept, the leading
Ritz vectors replace them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT of an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Entries of which SCALE * c isn't smaller have no exact sums and count as not finite.
MOST = float(1 << 31)
#: Rows that are multiplied at once.
ROWS = 4096
#: Eigenvalues up to this share of the largest are zero.
ZERO = 1e-12


@dataclass
class Whitening:
    """What was fitted: n vectors with sums of x by dimension; unit eigenvectors as columns, by falling eigenvalue; trace of the covariance;
    passes over the rows; the largest residual as a share of the largest eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def rounded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the rows that have a whole vector of finite entries, the lengths of all rows, and all entries as whole numbers without SHIFT."""
    vec = batch.column("vec")
    size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
    fine = np.abs(flat) < MOST  # false for what isn't a number
    bad = np.concatenate([[0], np.cumsum(~fine)])
    end = np.cumsum(size)
    ok = vec.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
    return ok, size, np.floor(np.where(fine, flat, 0)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers without SHIFT) of rows of ``dim`` finite entries, ``ROWS`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ok, size, flat = rounded(part)
            ok &= size == dim
            if ok.any():
                yield part.column("id").filter(pa.array(ok)), flat[np.repeat(ok, size)].reshape(-1, dim)


def usual_length(rows: DataFrame) -> int:
    """The commonest length of vectors, the longest of several; 0 if there is none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, _ = rounded(batch)
            dims, n = np.unique(size[ok & (size > 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(n.astype(np.int64))], ["dim", "n"])

    found = rows.mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return found[0].dim if found else 0


def column_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors of that length, and the exact sums of x by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, y in slices(batches, dim):
            n += len(y)
            total = [a + b for a, b in zip(total, y.sum(0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim), pa.array(total, pa.int64())], ["i", "n", "total"])

    found = rows.mapInArrow(partial, "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n = found[0].n if found else 0
    return n, [int(r.total) + n * SHIFT for r in sorted(found, key=lambda r: r.i)]


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers near the means of x - SHIFT, and what n times them lacks of the sums: n (y - near) - lack is n x - S, in small numbers."""
    near = [round((s - n * SHIFT) / n) for s in sums]
    return np.array(near, np.int64), np.array([s - n * SHIFT - n * y for s, y in zip(sums, near, strict=True)], np.int64)


def summed(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], height: int, width: int) -> np.ndarray:
    """The sum of the tasks' (height, width) matrices, added up by Spark row by row."""
    names = [f"z{j}" for j in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = kernel(batches)
        if z is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in z.T)], ["i", *names])

    total = rows.mapInArrow(partial, ", ".join(["i int", *(f"{c} double" for c in names)])).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
    out = np.zeros((height, width))
    for r in total:
        out[r.i] = r[1:]
    return out


def products(rows: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``q`` (Xᵀ(XQ) / n of centred rows), and the covariance's trace, in one pass."""
    dim, width = q.shape
    near, lack = centre(n, sums)

    def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        z = None
        for _, y in slices(batches, dim):
            x = (y - near) - lack / n
            z = np.zeros((dim + 1, width)) if z is None else z
            z[:dim] += x.T @ (x @ q)
            z[dim, 0] += (x * x).sum()
        return z

    z = summed(rows, kernel, dim + 1, width) / n
    return z[:dim], z[dim, 0]


def new_directions(w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what of ``w`` lies outside of ``q``."""
    for _ in range(2):
        w = w - q @ (q.T @ w)
        size = np.sqrt((w * w).sum(0))
        w = w[:, size > 1e-15] / size[size > 1e-15]
        w, r = np.linalg.qr(w)
        w = w[:, np.abs(np.diag(r)) > 1e-12]
    return w - q @ (q.T @ w)


def fit_whitening(df: DataFrame, column: str = "embedding", k: int = 32, more: int = 8, kept: int = 6, tolerance: float = 1e-13, most_passes: int = 500, seed: int = 42) -> Whitening | None:
    """The ``k`` leading components of all vectors of ``df``; None without vectors.

    Blocks have ``k + more`` columns, up to ``kept`` blocks are held. Vectors that are null, empty or hold null or non-finite entries take no part, nor
    do those of another than the commonest length. Components of no variance are left out. ``df`` is read once a pass and should be a table.
    Raises ArithmeticError if the residuals aren't below ``tolerance`` times the largest eigenvalue after ``most_passes``.
    """
    rows = df.select(F.lit(0).alias("id"), F.col(column).alias("vec"))
    dim = usual_length(rows)
    if not dim:
        return None
    n, sums = column_sums(rows, dim)
    block, k = min(dim, k + more), min(dim, k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, block)))[0]
    aq, trace = products(rows, n, sums, q)
    passes = 1
    while True:
        h = q.T @ aq
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        lead = u[:, :block]
        x, ax = q @ lead, aq @ lead
        residual = ax - x * theta[:block]
        off = np.sqrt((residual[:, :k] ** 2).sum(0)).max() / max(theta[0], np.finfo(float).tiny)
        w = new_directions(residual, q) if off > tolerance and q.shape[1] < dim else q[:, :0]
        if not w.shape[1]:  # certified, or the blocks span all there is
            break
        if passes == most_passes:
            raise ArithmeticError(f"components are certain to {off:.1e} only after {passes} passes")
        w = w[:, : dim - q.shape[1]]
        if q.shape[1] + w.shape[1] > kept * block:
            q, aq = q @ u[:, : 2 * block], aq @ u[:, : 2 * block]
        aw, _ = products(rows, n, sums, w)
        q, aq, passes = np.hstack([q, w]), np.hstack([aq, aw]), passes + 1
    real = np.flatnonzero(theta[:k] > ZERO * theta[0]) if theta[0] > 0 else np.arange(0)
    x = x[:, real] / np.sqrt((x[:, real] ** 2).sum(0))
    return Whitening(n, sums, x, theta[real].copy(), trace, passes, off)


def projector(fit: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """Whole numbers without SHIFT to whitened coordinates."""
    near, lack = centre(fit.n, fit.sums)
    onto, n = fit.vectors / np.sqrt(fit.values), fit.n
    return lambda y: ((y - near) - lack / n) @ onto


def deviations(fit: Whitening) -> Callable[[np.ndarray], pa.Array]:
    """Sums of (n x - S)² over the dimensions, exact; null where a long can't hold them."""
    near, lack = centre(fit.n, fit.sums)
    n, width = fit.n, fit.dim

    def of(y: np.ndarray) -> pa.Array:
        y = y - near
        if (n * float(np.abs(y).max()) + float(np.abs(lack).max())) ** 2 * width < 2**62:
            z = n * y - lack
            return pa.array((z * z).sum(1))
        each = ((n * y.astype(object) - lack.astype(object)) ** 2).sum(1)
        return pa.array([int(v) if v < 2**63 else None for v in each], pa.int64())

    return of


def identity_error(df: DataFrame, fit: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all of them."""
    rows = df.select(F.lit(0).alias("id"), F.col(column).alias("vec"))
    onto, dim, k = projector(fit), fit.dim, len(fit.values)

    def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        z = None
        for _, y in slices(batches, dim):
            w = onto(y)
            z = np.zeros((k + 1, k)) if z is None else z
            z[:k] += w.T @ w
            z[k] += w.sum(0)
        return z

    z = summed(rows, kernel, k + 1, k) / fit.n
    return float(np.abs(z[:k] - np.outer(z[k], z[k]) - np.eye(k)).max(initial=0))


def whitened(df: DataFrame, fit: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(``key``, deviation long, whitened array<double>) of the rows of ``df`` that a fit takes; rows repeated stay repeated."""
    onto, spread, dim = projector(fit), deviations(fit), fit.dim

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y in slices(batches, dim):
            w = onto(y)
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([ids, spread(y), pa.ListArray.from_arrays(at, pa.array(w.ravel()))], ["id", "deviation", "whitened"])

    kind = df.select(F.col(key).alias("id")).schema["id"].dataType.simpleString()
    out = df.select(F.col(key).alias("id"), F.col(column).alias("vec")).mapInArrow(project, f"id {kind}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", key)


def whitening_table(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 32, **options) -> DataFrame:
    """One row per vector and component: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, of another than the commonest length or with null or non-finite entries (or 2^31 / 64 and above) are left out; equal rows stay
    as often as they come; components of no variance have no rows (so one vector, or equal vectors, give none). An empty table gives an
    empty one. Extra columns are ignored.
    """
    fit = fit_whitening(df, column, k, **options)
    if fit is None or not len(fit.values):
        kind = df.select(F.col(key)).schema[0].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(df, fit, column)
    share = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values))
    out = whitened(df, fit, key, column).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        key, (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
