"""Line dedup: an exact set-similarity join of the corpus's lines, and removal of what matches an earlier line.

A line is the set of its words, ordered by rarity. Two lines of Jaccard 0.8 or more share a word among the rarest of each (prefix filter),
have sizes within that ratio (length filter), and the shared word's places leave room for enough others (positional filter). A first
round of postings with 128-bit sketches finds the lines that can have a match at all; a second moves only their whole word sets, verifies
Jaccard and keeps, for each line, whether an earlier one matches, so pairs are never emitted. Words that very many lines
have among their rarest are left to the second round, which deals their lines into cells, one for each pair of chunks.

No key's rows meet in one task of the first round: a task sends a line on once for each window of many lines, whatever number of its
texts hold it, and postings of words that the corpus has very often are salted; their lines are candidates at once.

Words and lines stand for their 64-bit hashes, and lines of equal hashes for equal lines; postings of the first round carry 40 bits of
these. Two lines of equal 40 bits under one word are one posting, which finds what either alone would find with other lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter
from .lm import COUNTS, blobs, bucket_edges, counted_sorted, decoded, encoded, merged, word_totals
from .scratch import drop, save, unused
from .tokens import Lookup, Words, mix, prefix_sums, slices, span_hashes, tidied

#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
SCHEMA = "bucket int, kind int, blob binary"
POSTING, FIRST, REMOVED, CANDIDATE, HOT, SALTED = range(6)
#: Hot words that are broadcast at once, of 16 bytes each; more of them take more passes, each over a range of the words' hashes.
HOT_WORDS = 1 << 20
#: Occurrences in the corpus, as a multiple of the postings that make a word hot, above which its postings are salted.
SALT_FROM = 16
#: Distinct lines that a task knows before it sends their first places on.
WINDOW_LINES = 1 << 19
#: Bytes of text for each bucket beyond those that the session's partitions give.
BUCKET_BYTES = 32 << 20
#: Bytes of text whose lines are worked on at once.
SLICE_BYTES = 2 << 20
#: Words that a task counts before it sends the counts on.
COUNTED = 1 << 22


def least(size: np.ndarray) -> np.ndarray:
    """Fewest words that a match of a line with that many can have."""
    return -(-NUM * size // DEN)


def overlap(total: np.ndarray) -> np.ndarray:
    """Shared words that two lines need whose sizes add up to ``total``."""
    return -(-NUM * total // (NUM + DEN))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class Lines:
    """The lines of some texts: document (row), number in it, hash of the lower-cased line, and its words."""

    doc: np.ndarray
    number: np.ndarray
    name: np.ndarray
    start: np.ndarray
    words: Words
    total: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Lines:
        words = Words(column)
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        n = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(column)) + 1
        first = np.cumsum(n) - n
        start, end = np.zeros(int(n.sum()), np.int64), np.zeros(int(n.sum()), np.int64)
        inner = np.ones(len(start), bool)
        inner[first] = False
        start[first], start[inner] = offsets[:-1], breaks + 1
        inner = np.ones(len(start), bool)
        inner[first + n - 1] = False
        end[first + n - 1], end[inner] = offsets[1:], breaks
        doc = np.repeat(np.arange(len(column)), n)
        total = prefix_sums(data)
        return Lines(doc, np.arange(len(start)) - first[doc], span_hashes(data, start, end, total), start, words, total)

    def earliest(self, doc_id: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines ``some``, one for each distinct line, the earliest by doc_id and number; and the others but those in its place."""
        order = some[np.lexsort((self.number[some], doc_id[self.doc[some]], self.name[some]))]
        head = np.concatenate([[True], self.name[order][1:] != self.name[order][:-1]]) if len(order) else np.zeros(0, bool)
        own = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
        same = (doc_id[self.doc[order]] == doc_id[self.doc[own]]) & (self.number[order] == self.number[own])
        return order[head], order[~same]

    def sets(self, some: np.ndarray, often: Lookup, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of the lines ``some``, rarest first, one line after another, and each line's number of them.

        Words outside ``often`` (with ranks by count) come first, by hash; any order that is the same everywhere is right.
        """
        place = np.full(len(self.start), -1)
        place[some] = np.arange(len(some))
        words = np.diff(np.searchsorted(self.words.start, self.start), append=len(self.words.start))
        line = np.repeat(place, words)
        used = np.flatnonzero(line >= 0)
        line = line[used]
        word = mix(span_hashes(self.words.data, self.words.start[used], self.words.end[used], self.total))
        at, known = often.find(word)
        key = np.where(known, (rank[at] << np.uint64(40)) | np.uint64(1 << 63), word >> np.uint64(1)) if len(rank) else word >> np.uint64(1)
        bits = max(1, len(some)).bit_length()
        if bits <= 20:  # one sort of line and leading bits of the key; these tell the words of a line apart
            order = np.argsort((line.astype(np.uint64) << np.uint64(64 - bits)) | (key >> np.uint64(bits)))
        else:
            order = np.lexsort((key, line))
        line, key = line[order], key[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (key[1:] != key[:-1])]) if len(line) else np.zeros(0, bool)
        return key[new], np.bincount(line[new], minlength=len(some))


def prefixes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets one after another: flat places of the prefix words, the set of each, and its place there."""
    n = size - least(size) + 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), n)
    flat = ranges(begin, n)
    return flat, owner, flat - begin[owner]


def planes(x: np.ndarray, n: int) -> bytes:
    """The lower ``n`` bytes of integers, bytes of one place together."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplaned(blob: memoryview, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8, count * n).reshape(n, count).T
    return out.view(np.uint64).ravel()


_WIDTHS = (5, 5, 4, 4, 8, 8)


def postings(blobs: list[pa.Buffer]) -> list[np.ndarray]:
    """The columns of blobs of postings, each filled in place."""
    n = [len(blob) // sum(_WIDTHS) for blob in blobs]
    columns, at = [np.zeros(sum(n), np.uint64) for _ in _WIDTHS], 0
    for blob, m in zip(blobs, n, strict=True):
        view, begin = memoryview(blob), 0
        for column, width in zip(columns, _WIDTHS, strict=True):
            column[at : at + m] = unplaned(view[begin : begin + m * width], m, width)
            begin += m * width
        at += m
    return columns


def sketches(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit parities of the sets: sets differ in at least as many words as their sketches in bits."""
    bit = mix(key)
    one = np.uint64(1) << (bit & np.uint64(63))
    high = (bit >> np.uint64(6)) & np.uint64(1)
    begin = np.cumsum(size) - size
    return tuple(np.bitwise_xor.reduceat(np.where(high == side, one, np.uint64(0)), begin) if len(begin) else np.zeros(0, np.uint64) for side in (0, 1))


def pairs(token: np.ndarray, size: np.ndarray, place: np.ndarray, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings (sorted by token, then size) that pass the prefix, length and positional filters, in blocks."""
    if not len(token):
        return
    group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
    keys = (group << 32) | size
    short = np.flatnonzero(place < size - -(-2 * NUM * size // (NUM + DEN)) + 1)
    low = np.searchsorted(keys[short], (group << 32) | least(size))
    del group, keys
    n = np.searchsorted(short, np.arange(len(token)))
    n -= low
    np.maximum(n, 0, out=n)
    upto = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + block, "right")))
        i, j = short[ranges(low[start:end], n[start:end])], np.repeat(np.arange(start, end), n[start:end])
        room = 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1)
        fits = room >= overlap(size[i] + size[j])
        yield i[fits], j[fits]
        start = end


def count_words(docs: DataFrame, buckets: int, most: int = COUNTED) -> DataFrame:
    """(bucket, kind, blob): each bucket's words with their counts."""

    def out(names: np.ndarray) -> Iterator[pa.RecordBatch]:
        for few in batched(encoded(*counted_sorted(names), bucket_edges(buckets), COUNTS), 16):
            yield blobs(list(few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(most, np.uint64), 0  # filled and sorted in place
        for batch in batches:
            for part in slices(batch, "text"):
                names = mix(Words(part.column("text")).hashes())
                if n + len(names) > len(held):
                    if n:
                        yield from out(held[:n])
                    n = 0
                if len(names) > len(held):  # a long text alone
                    yield from out(names)
                    continue
                held[n : n + len(names)] = names
                n += len(names)
        if n:
            yield from out(held[:n])

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        names, counts = merged([decoded(b.as_buffer()) for b in rows.column("blob")])
        return pa.Table.from_batches([blobs([(group[0].as_py(), COUNTS, names.tobytes() + counts.tobytes())])])

    return docs.select("text").mapInArrow(count, SCHEMA).groupBy("bucket").applyInArrow(tidied(merge), SCHEMA)


class Window:
    """The lines, with the earliest place of each, that a task has met since it last began anew."""

    def __init__(self) -> None:
        self.names, self.doc, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each line is or would be, and whether it is known."""
        at = np.searchsorted(self.names, name)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == name[known]
        return at, known

    def add(self, at: np.ndarray, name: np.ndarray, doc: np.ndarray, number: np.ndarray) -> None:
        """New lines, each once and sorted, at the places ``find`` gave."""
        self.names, self.doc, self.number = np.insert(self.names, at, name), np.insert(self.doc, at, doc), np.insert(self.number, at, number)

    def meet(self, at: np.ndarray, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Other places of known lines: whether each is the earliest now, and the (doc, number) of whichever is later than the other."""
        own, held = np.stack([doc, number]), np.stack([self.doc[at], self.number[at]])
        earlier = (doc < held[0]) | ((doc == held[0]) & (number < held[1]))
        self.doc[at[earlier]], self.number[at[earlier]] = doc[earlier], number[earlier]
        return earlier, np.where(earlier, held, own)[:, (own != held).any(0)]


def removed_lines(
    docs: DataFrame, min_words: int = 1, often_words: int = 1 << 17, buckets: int | None = None, bloom_mb: int = 64, hot_rows: int = 8192, hot_words: int = HOT_WORDS, window_lines: int = WINDOW_LINES
) -> DataFrame:
    """(doc_id, line): lines with at least ``min_words`` distinct words whose Jaccard with a line at an earlier place is 0.8 or more.

    Places are ordered by doc_id and line number; lines of one place (a repeated row's) don't remove each other. The result is a written
    table. The filter of candidates has 32 bits for each up to ``bloom_mb``; with more of them, more sets move than need to, and the
    result stays. Up to ``hot_words`` hot words are broadcast at once; with more, the texts are read once more for each such number.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    counted = save(count_words(docs, buckets), "words")
    _, _, often, counts = word_totals(counted, often_words)
    drop(counted)
    rank = np.argsort(np.lexsort((often, counts))).astype(np.uint64)
    salts = spark.sparkContext.broadcast(-(-np.sort(counts) // (SALT_FROM * hot_rows)))  # by rank
    table = spark.sparkContext.broadcast((Lookup(often), rank))
    edges = bucket_edges(buckets)

    def bucketed(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        order = np.argsort(key)
        cut = np.concatenate([[0], np.searchsorted(key[order], edges), [len(key)]])
        return order, [(b, slice(int(cut[b]), int(cut[b + 1]))) for b in np.flatnonzero(np.diff(cut)).tolist()]

    def salts_of(key: np.ndarray) -> np.ndarray:
        """Into how many parts the postings of a set's words are dealt; words outside the frequent ones have fewer than any of these."""
        if not len(salts.value):
            return np.ones(len(key), np.int64)
        often = key >> np.uint64(63) > 0
        return np.where(often, salts.value[np.where(often, (key >> np.uint64(40)) & np.uint64((1 << 23) - 1), 0).astype(np.int64)], 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Window()

        def gone(doc: np.ndarray, number: np.ndarray) -> list[tuple[int, int, bytes]]:
            order, cuts = bucketed(mix(doc.view(np.uint64)))
            return [(b, REMOVED, np.stack([doc[order[s]], number[order[s]]]).tobytes()) for b, s in cuts]

        def first() -> pa.RecordBatch:
            places = np.stack([window.names.view(np.int64), window.doc, window.number])
            order, cuts = bucketed(window.names)
            return blobs([(b, FIRST, places[:, order[s]].tobytes()) for b, s in cuts])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lines, doc_id = Lines.of(part.column("text")), part.column("doc_id").to_numpy()
                one, later = lines.earliest(doc_id, np.arange(len(lines.name)))
                at, known = window.find(lines.name[one])
                again, fresh = one[known], one[~known]
                key, size = lines.sets(fresh, *table.value)
                enough = size >= min_words
                _, beaten = window.meet(at[known], doc_id[lines.doc[again]], lines.number[again])
                new = fresh[enough]
                window.add(at[~known][enough], lines.name[new], doc_id[lines.doc[new]], lines.number[new])
                later = later[window.find(lines.name[later])[1]]
                out = gone(np.concatenate([beaten[0], doc_id[lines.doc[later]]]), np.concatenate([beaten[1], lines.number[later]]))
                name, key, size = lines.name[new], key[np.repeat(enough, size)], size[enough]
                low, high = sketches(key, size)
                flat, owner, place = prefixes(size)
                token, parts = mix(key[flat]), salts_of(key[flat])
                salted = parts > 1
                order, cuts = bucketed(token[~salted])
                order = np.flatnonzero(~salted)[order]
                for b, s in cuts:
                    o = order[s]
                    w = owner[o]
                    out.append((b, POSTING, b"".join(planes(x, n) for x, n in zip((token[o] >> np.uint64(24), name[w] >> np.uint64(24), size[w], place[o], low[w], high[w]), _WIDTHS, strict=True))))
                token, owner, parts = token[salted], owner[salted], parts[salted]
                order, cuts = bucketed(mix(token ^ mix(name[owner] % parts.astype(np.uint64))))
                for b, s in cuts:
                    o = order[s]
                    out.append((b, SALTED, np.stack([token[o] >> np.uint64(24), name[owner[o]] >> np.uint64(24)]).tobytes()))
                if out:
                    yield blobs(out)
                if len(window.names) >= window_lines:
                    yield first()
                    window = Window()
        if len(window.names):
            yield first()

    def meet(group: tuple, rows: pa.Table) -> pa.Table:
        kinds, column = rows.column("kind").to_numpy(), rows.column("blob")
        held = {kind: [column[k].as_buffer() for k in np.flatnonzero(kinds == kind).tolist()] for kind in (POSTING, FIRST, REMOVED, SALTED)}
        bucket, gone = group[0].as_py(), [np.frombuffer(b, np.int64).reshape(2, -1) for b in held[REMOVED]]
        if held[FIRST]:
            name, doc, number = np.concatenate([np.frombuffer(b, np.int64).reshape(3, -1) for b in held[FIRST]], axis=1)
            order = np.lexsort((number, doc, name))
            head = np.concatenate([[True], name[order][1:] != name[order][:-1]])
            own = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            later = order[(doc[order] != doc[own]) | (number[order] != number[own])]
            gone.append(np.stack([doc[later], number[later]]))
        found, hot = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
        if held[POSTING]:
            columns = postings(held[POSTING])
            token, name, size = columns[:3]
            order = np.lexsort((name, size, token))
            order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (name[order][1:] != name[order][:-1])])]
            names, n = np.unique(token[order], return_counts=True)
            hot = np.stack([names[n > hot_rows].view(np.int64), n[n > hot_rows]])
            many = np.repeat(n > hot_rows, n)
            found, order = name[order[many]], order[~many]  # of hot words, the second round tells
            del token, name, size, many
            for k in range(len(columns)):  # one column after the other: no two copies of all
                columns[k] = columns[k][order]
            del order
            token, name, size, place, low, high = columns
            size, place = size.view(np.int64), place.view(np.int64)
            matched = np.zeros(len(token), bool)
            for i, j in pairs(token, size, place):
                total = size[i] + size[j]
                near = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j]) <= total - 2 * overlap(total)
                matched[i[near]] = matched[j[near]] = True
            found = np.union1d(found, name[matched])
        if held[SALTED]:
            token, name = np.concatenate([np.frombuffer(b, np.uint64).reshape(2, -1) for b in held[SALTED]], axis=1)
            order = np.lexsort((name, token))
            token, name = token[order], name[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])
            names, n = np.unique(token[new], return_counts=True)
            hot = np.concatenate([hot, np.stack([names.view(np.int64), n])], axis=1)
            found = np.union1d(found, name[new])
        out = [(bucket, CANDIDATE, found.tobytes()), (bucket, HOT, hot.tobytes())]
        if gone:
            out.append((bucket, REMOVED, np.concatenate(gone, axis=1).tobytes()))
        return pa.Table.from_batches([blobs(out)])

    met = save(docs.mapInArrow(post, SCHEMA).groupBy("bucket").applyInArrow(tidied(meet), SCHEMA), "met")
    candidates = met.where(F.col("kind") == CANDIDATE)
    n = candidates.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)) / 8).first()[0]
    again = spark.sparkContext.broadcast(bloom_filter(candidates.mapInArrow(unfold(1, ("key",)), "key long"), bloom_mb, int(n)))
    hot = met.where(F.col("kind") == HOT).mapInArrow(unfold(2, ("token", "n")), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows)
    hot = save(hot, "hot")
    passes = max(1, -(-hot.count() // hot_words))

    def split_words(turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The hot words of a pass and the number of chunks of each."""
        own = hot.where(F.shiftright(F.col("token") * passes, 40) == turn).toArrow().sort_by("token")
        return own.column("token").to_numpy(), -(-own.column("n").to_numpy() // hot_rows)

    def dealt(split: tuple[np.ndarray, np.ndarray], turn: int, token: np.ndarray, owner: np.ndarray, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
        """A pass's postings with their side: those of a hot word go to the cells of their chunk with each chunk, where two sides (0, 1) meet; -1 else."""
        words, chunks = split
        short = (token >> np.uint64(24)).view(np.int64)
        if passes > 1:
            own = (short * passes) >> 40 == turn
            token, owner, place, name, short = token[own], owner[own], place[own], name[own], short[own]
        if not len(words):
            return token, owner, place, np.full(len(token), -1)
        at = np.minimum(np.searchsorted(words, short), len(words) - 1)
        n = np.where(words[at] == short, chunks[at], 1)
        row = np.repeat(np.arange(len(token)), n)
        own, other = (name % n.astype(np.uint64)).astype(np.int64)[row], np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.minimum(own, other), np.maximum(own, other)
        cell = np.where(n[row] > 1, mix(token[row] ^ mix((low.astype(np.uint64) << np.uint64(32)) | (high + 1).astype(np.uint64))), token[row])
        return cell, owner[row], place[row], np.where(low == high, -1, (own == high).astype(np.int64))

    def repost(sent: Broadcast, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Window()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lines, doc_id = Lines.of(part.column("text")), part.column("doc_id").to_numpy()
                one, _ = lines.earliest(doc_id, np.flatnonzero(again.value.has(lines.name >> np.uint64(24))))
                if len(window.names) >= window_lines:
                    window = Window()
                at, known = window.find(lines.name[one])  # a line goes on once, and again only with an earlier place
                earlier, _ = window.meet(at[known], doc_id[lines.doc[one[known]]], lines.number[one[known]])
                new = one[~known]
                window.add(at[~known], lines.name[new], doc_id[lines.doc[new]], lines.number[new])
                goes = ~known
                goes[known] = earlier
                one = one[goes]
                key, size = lines.sets(one, *table.value)
                enough = size >= min_words
                key, size, one = key[np.repeat(enough, size)], size[enough], one[enough]
                flat, owner, place = prefixes(size)
                token, owner, place, side = dealt(sent.value, turn, mix(key[flat]), owner, place, lines.name[one][owner])
                begin = np.cumsum(size) - size
                order, cuts = bucketed(token)
                out = []
                for b, s in cuts:  # each line's set goes to a bucket once, however many postings it has there
                    o = order[s]
                    own, line = np.unique(owner[o], return_inverse=True)
                    at = one[own]
                    head = np.stack([lines.name[at].view(np.int64), doc_id[lines.doc[at]], lines.number[at], size[own]])
                    body = np.stack([token[o].view(np.int64), line, place[o], side[o]])
                    out.append((b, len(own), np.int64(len(o)).tobytes() + head.tobytes() + body.tobytes() + key[ranges(begin[own], size[own])].tobytes()))
                    if len(out) == 32:
                        yield blobs(out)
                        out = []
                if out:
                    yield blobs(out)

    def verify(group: tuple, rows: pa.Table) -> pa.Table:
        heads, bodies, sets, lines = [], [], [], 0
        for m, blob in zip(rows.column("kind").to_pylist(), rows.column("blob"), strict=True):
            flat = np.frombuffer(blob.as_buffer(), np.int64)
            n, flat = int(flat[0]), flat[1:]
            body = flat[4 * m : 4 * m + 4 * n].reshape(4, n)
            heads.append(flat[: 4 * m].reshape(4, m))
            bodies.append(body + np.array([[0], [lines], [0], [0]]))
            sets.append(flat[4 * m + 4 * n :].view(np.uint64))
            lines += m
        head, body, flat = np.concatenate(heads, axis=1), np.concatenate(bodies, axis=1), np.concatenate(sets)
        del heads, bodies, sets
        begin = np.cumsum(head[3]) - head[3]
        token, line, place, side = body
        order = np.lexsort((head[2][line], head[1][line], head[0][line], head[3][line], token.view(np.uint64)))
        token, line, place, side = token[order], line[order], place[order], side[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (head[0][line[1:]] != head[0][line[:-1]])])
        token, line, place, side = token[new], line[new], place[new], side[new]
        _, doc, number, size = head[:, line]
        begin, before = begin[line], np.zeros(len(line), bool)
        for i, j in pairs(token, size, place):
            apart = (side[i] < 0) | (side[i] != side[j])
            i, j = i[apart], j[apart]
            earlier = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (number[i] < number[j]))
            later_first = (doc[j] < doc[i]) | ((doc[i] == doc[j]) & (number[j] < number[i]))
            old, new = np.where(earlier, i, j)[earlier | later_first], np.where(earlier, j, i)[earlier | later_first]
            by = np.lexsort((number[old], doc[old], new))
            old, new = old[by], new[by]
            while len(new):  # each line against its earliest partner left, until one matches
                old, new = old[~before[new]], new[~before[new]]
                turn = np.concatenate([[True], new[1:] != new[:-1]]) if len(new) else np.zeros(0, bool)
                a, b = old[turn], new[turn]
                shared = shared_words(flat, begin, size, a, b)
                before[b[shared >= overlap(size[a] + size[b])]] = True
                old, new = old[~turn], new[~turn]
        gone = np.unique(np.stack([doc[before], number[before]]), axis=1)
        return pa.table({"doc_id": gone[0], "line": gone[1]})

    schema = "doc_id long, line long"
    found = [met.where(F.col("kind") == REMOVED).mapInArrow(unfold(2, ("doc_id", "line")), schema)]
    for turn in range(passes):
        sent = spark.sparkContext.broadcast(split_words(turn))
        similar = docs.mapInArrow(partial(repost, sent, turn), SCHEMA).groupBy("bucket").applyInArrow(tidied(verify), schema)
        found.append(similar if passes == 1 else save(similar, "similar"))
        if passes > 1:
            sent.destroy()
    gone = save(reduce(DataFrame.unionByName, found), "gone")
    for done in (met, hot, *(found[1:] if passes > 1 else [])):
        drop(done)
    return gone


def unfold(n: int, names: tuple[str, ...]):
    """Rows of blobs of ``n`` long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(blob, np.int64).reshape(n, -1)], list(names))

    return run


def shared_words(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Sizes of the intersections of sets a and b, taken in blocks of about ``block`` words."""
    out = np.zeros(len(a), np.int64)
    upto, start = np.cumsum(size[a] + size[b]), 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + block, "right")))
        x, y = a[start:end], b[start:end]
        pair = np.concatenate([np.repeat(np.arange(len(x)), size[x]), np.repeat(np.arange(len(x)), size[y])])
        word = np.concatenate([flat[ranges(begin[x], size[x])], flat[ranges(begin[y], size[y])]])
        order = np.lexsort((word, pair))
        pair, word = pair[order], word[order]
        out[start:end] = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])], minlength=len(x))
        start = end
    return out


def dedup_lines(docs: DataFrame, min_words: int = 1, bloom_mb: int = 64, hot_rows: int = 8192) -> DataFrame:
    """All columns of ``docs``, with text without the removed lines, n_lines and n_removed.

    Lines are cut at line feeds; those with fewer than ``min_words`` distinct words always stay. A line goes if any line at an earlier place
    (doc_id, line number) has Jaccard 0.8 or more with it, whether that one stays or not. Null texts stay null with 0 lines, empty
    ones have one empty line; documents without a doc_id are left alone. Rows repeated under an id lose the same lines.
    Columns named like the new ones are replaced; an empty table gives an empty one. A word with over ``hot_rows`` lines is split. Only documents that lose lines, and those
    that the Bloom filter takes for such, are shuffled to meet their lists.
    """
    docs = docs.drop("n_lines", "n_removed")
    numbers, touched, key, cut = unused([*docs.columns, "n_lines", "n_removed"], "gone", "touched", "gone_id", "cut")
    gone = removed_lines(docs, min_words, bloom_mb=bloom_mb, hot_rows=hot_rows)
    lists = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(numbers))
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(gone.select(F.col("doc_id").alias("key")), bloom_mb))

    @F.pandas_udf("boolean")
    def may_lose(doc_id: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(doc_id.fillna(0).to_numpy(np.int64).view(np.uint64)) & doc_id.notna().to_numpy())

    marked = docs.withColumn(touched, may_lose(F.col("doc_id").cast("long")))
    lines = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    alone = marked.where(~F.col(touched)).withColumn("n_lines", n_lines).withColumn("n_removed", F.lit(0).cast("long"))
    met = marked.where(touched).join(lists.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(key), "left").withColumn("n_lines", n_lines)
    met = met.withColumn(cut, F.when(F.col(numbers).isNotNull(), lines))  # cut once; the lines that stay are found by one pass over both lists
    stays = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(cut).cast("long") - 1), F.col(numbers))
    met = met.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(cut), i.cast("int"))), "\n")))
    met = met.withColumn("n_removed", F.coalesce(F.size(numbers), F.lit(0)).cast("long")).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    columns = [*docs.columns, "n_lines", "n_removed"]
    return alone.select(*columns).unionByName(met.select(*columns))
