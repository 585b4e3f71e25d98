"""Embedding near-duplicates with Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, and the projections are quantised in steps of ``width``; the k steps of a table
name a bucket. A first pass moves ids with 128-bit sketches alone and finds the rows that share a bucket with one that may be near; a second
moves the vectors of these rows only, and takes exact cosines in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import cells, components, local_roots
from .scratch import drop, save

#: Random signs of a sketch, and the standard deviations that a pair at the least cosine may differ in more of them than expected.
SIGNS, SLACK = 128, 6.0
#: Tables that a bucket's number has room for; more are an error.
MOST_TABLES = 1 << 19


def collision_rate(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection is equal for two points at that Euclidean distance."""
    r = width / distance
    cdf = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_shape(n: int, cosine: float, width: float, recall: float, strangers: int = 64) -> tuple[int, int]:
    """(k, tables): k leaves about ``strangers`` unrelated (orthogonal) vectors in a bucket, by log n, which sketches tell apart; tables
    reach the recall at the least cosine that links."""
    near, far = collision_rate(math.sqrt(2 - 2 * cosine), width), collision_rate(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(n / strangers, 2)) / -math.log(far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))
    if tables > MOST_TABLES:
        raise ValueError(f"a recall of {recall} takes {tables} tables of {n} vectors, more than {MOST_TABLES}: choose a wider step, a lower recall or more strangers in a bucket")
    return k, tables


def differing_signs(cosine: float) -> int:
    """Most signs of a sketch that count as near: those expected at ``cosine`` and ``SLACK`` standard deviations."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p)))


def finite(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec array<float or double>): rows whose vector has a direction."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vec")).where(finite(F.col("vec")))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Rows of one vector length at a time, the length, and the unit vectors."""
    for batch in batches:
        lengths = np.diff(batch.column("vec").offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == dim)) if (lengths != dim).any() else batch
            x = matrix(part.column("vec"))
            yield part, dim, x / np.sqrt((x * x).sum(1))[:, None]


def bucket_codes(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) int32: the bucket of each unit vector in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    steps = np.floor((x @ rng.standard_normal((x.shape[1], tables * k))) / width + rng.random(tables * k)).astype(np.int64)
    mixed = (steps.reshape(-1, tables, k) * rng.integers(1, 1 << 62, (tables, k))).sum(2)
    return (mixed ^ (mixed >> 31)).astype(np.int32)


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """(rows, 2) int64: signs of ``SIGNS`` Gaussian projections."""
    rng = np.random.default_rng([seed + 1, x.shape[1]])
    return np.packbits(x @ rng.standard_normal((x.shape[1], SIGNS)) > 0, axis=1).view(np.int64)


def in_cells(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]] | None:
    """A task's rows in order of cell, bucket, length of vector and rep, and (begin, rows) of those equal in the first three that are two or more."""
    own = list(batches)
    if not own:
        return None
    rows = pa.Table.from_batches(own).sort_by([(c, "ascending") for c in ("cell", "bucket", "dim", "rep")]).combine_chunks()
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in ("cell", "bucket", "dim"):
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, rows.num_rows))
    return rows, list(zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True))


def near_vectors(
    df: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = 0.95, width: float = 2.0, recall: float = 0.98, group_rows: int = 1024, seed: int = 42
) -> DataFrame:
    """One row per row of ``df``: id ``key``, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Equal vectors are collapsed before the
    search, by their components, and count as linked. Vectors of different lengths never link. Each pair is counted in
    the first table in which it shares a bucket; links leave a task as counts and edges to a local root, not as pairs. Buckets of
    over ``group_rows`` are cut into cells. Extra columns are ignored; an empty table gives an empty one.
    """
    valid = vectors(df, key, column)
    exact = F.xxhash64("vec").alias("h")
    reps = save(valid.groupBy(exact, "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    k, tables = table_shape(reps.count(), cosine, width, recall)
    apart = differing_signs(cosine)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, dim, x in by_length(batches):
            codes, signs = bucket_codes(x, k, tables, width, seed), sketches(x, seed)
            table = np.tile(np.arange(tables), len(x))
            bucket = (dim % (1 << 11) << 51) | (table << 32) | (codes.ravel().astype(np.int64) & 0xFFFFFFFF)  # lengths that meet here are told apart by dim
            rep = np.repeat(part.column("rep").to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(rep), dim, np.int32)), pa.array(bucket), *(pa.array(np.repeat(s, tables)) for s in signs.T)], ["rep", "dim", "bucket", "low", "high"])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = in_cells(batches)
        if found is None:
            return
        rows, groups = found
        chunk, left, right = (rows.column(c).to_numpy() for c in ("chunk", "left", "right"))
        low, high = (rows.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))  # bits of signed numbers are counted without their sign
        hit = np.zeros(rows.num_rows, bool)
        for b, n in groups:
            s = slice(b, b + n)
            near = np.bitwise_count(low[s, None] ^ low[s]).astype(np.int16) + np.bitwise_count(high[s, None] ^ high[s]) <= apart
            if left[b] != right[b]:
                near &= chunk[s, None] != chunk[s]
            np.fill_diagonal(near, False)
            hit[s] = near.any(1)
        if hit.any():
            yield from rows.filter(pa.array(hit)).select(["rep", "dim", "bucket", "cell", "chunk", "left", "right"]).to_batches()

    signed = reps.select("rep", "vec").mapInArrow(sketched, "rep long, dim int, bucket long, low long, high long")
    dealt = cells(signed, "bucket", "rep", group_rows)
    near = save(dealt.repartition("cell").mapInArrow(suspects, "rep long, dim int, bucket long, cell long, chunk int, left int, right int"), "suspects")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, x in by_length(batches):
            codes = [row.tobytes() for row in bucket_codes(x, k, tables, width, seed)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("vec"), pa.array(codes, pa.binary())], ["rep", "copies", "vec", "codes"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = in_cells(batches)
        if found is None:
            return
        rows, groups = found
        for b, n in groups:
            part = rows.slice(b, n).combine_chunks()
            vec = part.column("vec").combine_chunks()
            rep, copies, chunk = (part.column(c).to_numpy() for c in ("rep", "copies", "chunk"))
            left, right, table = part.column("left")[0].as_py(), part.column("right")[0].as_py(), (part.column("bucket")[0].as_py() >> 32) & (MOST_TABLES - 1)
            x = matrix(vec)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int32).reshape(n, -1)
            norm = np.sqrt((x * x).sum(1))
            linked = (x @ x.T) / (norm[:, None] * norm) >= cosine
            np.fill_diagonal(linked, False)
            if left != right:
                linked &= chunk[:, None] != chunk
            for t in range(table):
                linked &= codes[:, t][:, None] != codes[:, t]
            count = linked @ copies
            some = np.flatnonzero(count)
            if len(some):
                root = local_roots(n, *np.nonzero(linked))
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(count[some])], ["a", "b", "n"])

    kind = dict(reps.dtypes)["vec"]
    whole = reps.join(near.select("rep").distinct(), "rep", "left_semi").select("rep", "copies", "vec").mapInArrow(coded, f"rep long, copies long, vec {kind}, codes binary")
    found = save(near.join(whole, "rep").repartition("cell").mapInArrow(links, "a long, b long, n long"), "links")
    drop(near)
    label = components(found)
    total = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    members = valid.select("id", exact, "vec").join(
        reps.join(total, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("h", "vec", "rep", "copies", "n", "component"), ["h", "vec"]
    )
    done = members.select(F.col("id").alias(key), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vec")).where(~finite(F.col("vec")))
    rest = rest.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
