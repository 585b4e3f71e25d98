"""SimHash near-duplicates with a Gray-order hierarchical index of the fingerprints.

Fingerprints of at most three differing bits agree in one of four blocks at least (or, for many fingerprints, in some choice of the
blocks), so an index is built for each agreeing block. In it, fingerprints lie in Gray order; nodes over runs of neighbours hold the
bits all below share, and a child holds only shared bits that its parent lacks. A search adds up the differences on the
way down and leaves a whole group as soon as they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import cells, components, local_roots
from .scratch import save
from .tokens import Words, slices

BITS, FANOUT = 64, 8
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's space-joined shingles, in order, and the number of shingles by text."""
    length = words.end - words.start
    where = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(where[-1], 0x20, np.uint8)
    at = np.arange(int(length.sum())) + np.repeat(where[:-1] - np.concatenate([[0], np.cumsum(length)])[:-1], length)
    joined[at] = words.data[np.arange(int(length.sum())) + np.repeat(words.start - np.concatenate([[0], np.cumsum(length)])[:-1], length)]
    number = np.where(words.count == 0, 0, np.maximum(words.count - size + 1, 1))
    first = np.repeat(words.first[:-1], number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    last = first + np.repeat(np.minimum(words.count, size), number) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], seed) for s, e in zip(where[first].tolist(), (where[last + 1] - 1).tolist(), strict=True)), np.uint64, len(first))
    return hashes, number


def majority_bits(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """By text, the 64-bit integer of the bits set in over half of its hashes; 0 for a text without any."""
    out = np.zeros(len(number), np.uint64)
    some = np.flatnonzero(number)
    if not len(some):
        return out
    first = np.concatenate([[0], np.cumsum(number[some])])
    pieces = -(-number[some] // 255)  # byte counters hold up to 255
    start = np.repeat(first[:-1], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    packed = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], start, axis=0)
    counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, BITS).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[some] = np.packbits(2 * counts > number[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long) of all whole texts; null reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                fp = majority_bits(*shingle_hashes(Words(part.column("text")), size, seed))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def gray_index(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Order of the fingerprints by group and Gray rank, and the levels from the leaves up: (mask, value, parent).

    A node's mask has the bits shared by all below and not by all below its parent. Nodes never span groups; a level ends the tree
    when every group is one node. The last array is the group of each top node.
    """
    order = np.lexsort((gray_rank(fp), group))
    value, own = fp[order], group[order]
    shared = np.full(len(fp), np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = []
    while True:
        new = np.concatenate([[True], own[1:] != own[:-1]])
        if new.all():
            levels.append((shared, value, np.arange(len(own))))
            return order, levels, own
        begin = np.flatnonzero(new)
        rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        head = np.flatnonzero(rank % FANOUT == 0)
        parent = np.cumsum(rank % FANOUT == 0) - 1
        common = np.bitwise_and.reduceat(shared, head) & ~(np.bitwise_or.reduceat(value, head) ^ np.bitwise_and.reduceat(value, head))
        levels.append((shared & ~common[parent], value, parent))
        shared, value, own = common, value[head], own[head]


def gray_pairs(fp: np.ndarray, group: np.ndarray, most: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) within groups whose fingerprints differ in at most ``most`` bits, in blocks of queries."""
    if not len(fp):
        return
    order, levels, top = gray_index(fp, group)
    children = []
    for _, _, parent in levels[:-1]:
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        children.append((begin, np.diff(np.append(begin, len(parent)))))
    home = np.searchsorted(top, group)
    for start in range(0, len(fp), block):
        query = np.arange(start, min(start + block, len(fp)))
        node, spent = home[query], np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            mask, value, _ = levels[depth]
            spent = spent + np.bitwise_count((fp[query] ^ value[node]) & mask[node])
            near = spent <= most
            query, node, spent = query[near], node[near], spent[near]
            if depth:
                begin, size = children[depth - 1]
                n = size[node]
                query, spent = np.repeat(query, n), np.repeat(spent, n)
                node = np.repeat(begin[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = order[node]
        yield query[query < found], found[query < found]


def block_masks(n: int, most: int, group_rows: int = 256) -> list[int]:
    """Masks of which two fingerprints with at most ``most`` differing bits agree in one: all choices of m - most of m blocks.

    m grows with the number ``n`` of fingerprints, until a mask's bits would leave ``group_rows`` random ones to a group.
    """
    for m in range(most + 1, 3 * most + 2):
        edges = [round(BITS * k / m) for k in range(m + 1)]
        blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(m)]
        masks = [sum(c) for c in combinations(blocks, m - most)]
        if n / 2 ** min(x.bit_count() for x in masks) <= group_rows:
            break
    return masks


def simhash_components(docs: DataFrame, size: int = 3, seed: int = 42, most: int = 3, group_rows: int = 2048) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): documents linked at ``most`` or fewer differing bits, with the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and link like any other; rows repeated under a doc_id appear as often as they came;
    other columns of ``docs`` are ignored; an empty table gives an empty one. Copies count once in the search (one fingerprint), and the
    links of a group leave a task as edges to its smallest member.
    """
    prints = save(fingerprints(docs, size, seed), "fingerprints")
    reps = save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "reps")
    masks = block_masks(reps.count(), most)
    keys = reps.select(
        "fingerprint", "rep", F.explode(F.array([F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m))) for i, m in enumerate(masks)])).alias("block")
    )
    keys = save(keys, "blocks") if len(masks) <= 10 else keys

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        rep, fp, cell = (pa.Table.from_batches(own).column(c).to_numpy() for c in ("rep", "fingerprint", "cell"))
        _, group, n = np.unique(cell, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(n[group] > 1)
        keep = keep[np.lexsort((rep[keep], group[keep]))]
        rep, fp, group = rep[keep], fp[keep].view(np.uint64), group[keep]
        root = np.arange(len(rep))
        for a, b in gray_pairs(fp, group, most):
            root = local_roots(len(rep), np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root]))
        far = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[root[far]])], ["a", "b"])

    dealt = cells(keys, "block", "fingerprint", group_rows).select("rep", "fingerprint", "cell")
    edges = dealt.repartition("cell").mapInArrow(links, "a long, b long")
    found = components(edges)
    label = reps.join(found, reps.rep == found.node, "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
