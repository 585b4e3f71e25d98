"""Language-model scoring with a log-frequency Bloom filter.

Training texts' n-grams up to order three are counted exactly. Every count, of one too, enters the filter as its logarithmic level q: the n-gram is inserted
with each of 1..q, and a lookup probes 1, 2, ... until the first miss. The filter is built in parts, one for each bucket of n-grams, in the
tasks that count the bucket. A small filter is broadcast; to the parts of a larger one the n-grams of all texts are dealt by bucket, each once a
chunk of texts, and the levels found go back to the chunk. Probabilities are interpolated with absolute discounting from the probed counts.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import fold
from .scratch import drop, save
from .tokens import Words, give_back, mix, slices, unmix

LEVEL_BASE, LEVELS = 1.5, 96
#: Bits of the filter for each inserted (n-gram, level), and bits set for it, all in one 64-bit word.
BITS_PER_ENTRY, BITS_SET = 10, 4
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
UNI, BI, TRI, AFTER_1, AFTER_2 = range(5)
#: The filter's kind for contexts of either length, whose keys differ already.
AFTER = AFTER_1
#: Off each count seen, of one too; a multiple of a quarter, so that what follows a context adds up in whole quarters.
DISCOUNT = 0.75
#: Bytes of text for each bucket of n-grams, and bytes of the filter that the driver collects at once.
BUCKET_BYTES, COLLECT_BYTES = 4 << 20, 8 << 20
#: N-grams are counted in so many ranges of buckets, and texts probe in so many slices, one after the other: shuffles hold a share of the keys.
RANGES, TEXT_SLICES = 2, 4
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377], np.uint64)
#: Values that level 0, 1, 2, ... stand for: the geometric middle of the integers that have it.
VALUE = np.concatenate([[0.0], [float(np.exp(np.log(ints).mean())) if len(ints := np.arange(np.ceil(LEVEL_BASE ** (q - 1)), LEVEL_BASE**q)) else LEVEL_BASE ** (q - 1) for q in range(1, 25)], LEVEL_BASE ** (np.arange(25, LEVELS + 1) - 0.5)])


def level(value: np.ndarray) -> np.ndarray:
    """1 + floor(log value) for values from 1."""
    return np.minimum(1 + np.floor(np.log(value) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64), LEVELS)


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then one end), of the one and the two before, and each text's first token."""
    n = words.count + 1
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.full(first[-1], END)
    token[np.arange(len(words.doc)) + words.doc] = words.hashes()
    one = np.concatenate([[START], token[:-1]]) if len(token) else token
    one[first[:-1]] = START
    two = np.concatenate([[START], one[:-1]]) if len(token) else token
    two[first[:-1]] = START
    return token, one, two, first


def plain_keys(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of bigrams and trigrams, whose upper half names the words before."""
    low = token >> np.uint64(32)
    upper = np.uint64(0xFFFFFFFF00000000)
    return (mix(one ^ _SALT[BI]) & upper) | low, (mix(mix(two) + one ^ _SALT[TRI]) & upper) | low


def keys(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed 64-bit keys of the tokens and their bigrams and trigrams."""
    pair, triple = plain_keys(token, one, two)
    return mix(token), mix(pair), mix(triple)


def after(key: np.ndarray, kind: int) -> np.ndarray:
    """The key of the words before, of bigram (AFTER_1) or trigram (AFTER_2) keys."""
    return mix((unmix(key) >> np.uint64(32)) ^ _SALT[kind])


def bucket_edges(buckets: int) -> np.ndarray:
    """Where buckets begin among 64-bit numbers: between numbers of different upper halves, so that unmixed keys of one context stay together."""
    return np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each number, by the same bounds."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def encoded(names: np.ndarray, counts: np.ndarray, edges: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) of sorted keys with counts; bytes of one place lie together, which the shuffle's compression likes."""
    cut = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
    for b in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[b], cut[b + 1])
        yield b, kind, names[s].view(np.uint8).reshape(-1, 8).T.tobytes() + counts[s].astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.uint8).reshape(2, 8, -1)
    return tuple(np.ascontiguousarray(x.T).view(t).ravel() for x, t in zip(both, (np.uint64, np.int64), strict=True))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    names, counts = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((), ()), (np.uint64, np.int64), strict=True))
    order = np.argsort(names)
    names, counts = names[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    return names[head], np.add.reduceat(counts, head) if len(head) else counts


_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOBS.types, strict=True)], schema=_BLOBS)


def spots(key: np.ndarray, kind: int, q: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word, among ``words`` of its part, and the bits in it of each (key, level)."""
    x = mix(key + np.uint64(int(_SALT[kind]) * (2 * q + 1) % (1 << 64)))
    mask = np.uint64(1) << (x & np.uint64(63))
    for k in range(1, BITS_SET):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return ((x >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64), mask


def filter_part(entries: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A bucket's part of the filter, from (kind, keys, values from 1)."""
    levels = [level(v) for _, _, v in entries]
    total = sum(int(q.sum()) for q in levels)
    part = np.zeros(-(-total * BITS_PER_ENTRY // 64), np.uint64)
    for (kind, key, _), q in zip(entries, levels, strict=True):
        for step in range(1, int(q.max(initial=0)) + 1):
            some = key[q >= step]
            at, mask = spots(some, kind, step, np.full(len(some), len(part), np.uint64))
            np.bitwise_or.at(part, at, mask)
    return part.tobytes()


FILTER, COUNTS, TAIL = 10, 11, 12


def counted_sorted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs; sorts ``names`` in place."""
    names.sort()
    head = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return names[head], np.diff(head, append=len(names))


def count_ngrams(docs: DataFrame, buckets: int, context_buckets: int, flush: int = 3 << 19, own: tuple[int, int] | None = None) -> DataFrame:
    """(bucket, kind, blob): by bucket a filter part, the exact word counts, and by bucket of contexts the discounted counts that follow a word.
    Only buckets from ``own[0]`` to below ``own[1]``, if that is given.

    Trigrams are dealt by the two words before, so what follows these adds up in their bucket and goes into its part. Bigrams are dealt
    one by one, since a frequent word has very many; their sums by the word before meet in ``context_parts``.
    """

    least, beyond = own or (0, buckets)

    def inside(names: np.ndarray) -> np.ndarray:
        at = bucket_of(names, buckets)
        return names[(at >= least) & (at < beyond)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (UNI, BI, TRI):
                names = np.concatenate(held[kind])
                held[kind].clear()
                rows = []
                for row in encoded(*counted_sorted(names), bucket_edges(buckets), kind):
                    rows.append(row)
                    if len(rows) == 64:
                        yield blobs(rows)
                        rows = []
                if rows:
                    yield blobs(rows)

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                token, one, two, _ = sequence(Words(part.column("text")))
                pair, triple = plain_keys(token, one, two)
                for some, names in zip(held, (mix(token), mix(pair), triple), strict=True):
                    some.append(inside(names))
                size += len(token)
                if size >= flush:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        bucket, found, out = group[0].as_py(), [], []
        for kind in (UNI, BI, TRI):
            names, counts = merged([decoded(b) for k, b in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True) if k == kind])
            if kind == UNI:
                out.append((bucket, COUNTS, names.tobytes() + counts.tobytes()))
            elif kind == BI:
                out += encoded(*merged([(after(names, AFTER_1), 4 * counts - round(4 * DISCOUNT))]), bucket_edges(context_buckets), AFTER)
            else:
                head = np.flatnonzero(np.diff(names >> np.uint64(32), prepend=~names[:1] >> np.uint64(32)))
                sums = np.add.reduceat(4 * counts - round(4 * DISCOUNT), head) if len(head) else counts
                names = mix(names)
                found.append((AFTER, after(names[head], AFTER_2), sums))
            found.append((kind, names, counts))
        out.append((bucket, FILTER, filter_part(found)))
        del found
        give_back()
        return pa.Table.from_batches([blobs(out)])

    schema = "bucket int, kind int, blob binary"
    return docs.mapInArrow(count, schema).groupBy("bucket").applyInArrow(merge, schema)


def context_parts(counted: DataFrame, buckets: int) -> DataFrame:
    """Filter parts of the discounted totals after single words, numbered after the n-grams' parts."""

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        sums = merged([decoded(b) for b in rows.column("blob").to_pylist()])
        part = filter_part([(AFTER, *sums)])
        del sums
        give_back()
        return pa.Table.from_batches([blobs([(buckets + group[0].as_py(), FILTER, part)])])

    return counted.where(F.col("kind") == AFTER).groupBy("bucket").applyInArrow(merge, "bucket int, kind int, blob binary")


MARK = b"filter of levels"


def filter_room(n: int) -> tuple[bytearray, np.ndarray]:
    """Room for a filter of ``n`` words and the words in it, placed so that they are aligned in the file of a broadcast of this room."""
    head = pickle.dumps(bytearray(b"\xff" * (1 << 16)), pickle.HIGHEST_PROTOCOL).index(b"\xff" * 64)
    pad = -(head + len(MARK)) % 8
    room = bytearray(pad + len(MARK) + 8 * n)
    room[pad : pad + len(MARK)] = MARK
    return room, np.frombuffer(room, np.uint64, n, pad + len(MARK))


def shared_filter(sent: Broadcast, n: int) -> np.ndarray:
    """The words of a broadcast filter, mapped from the broadcast's file: the workers of an executor have one copy. If it can't be mapped
    (it is encrypted), it is loaded."""
    path = getattr(sent, "_path", None)
    if path:
        with open(path, "rb") as f:
            at = f.read(256).find(MARK)
        if at >= 0 and n:
            return np.memmap(path, np.uint64, "r", at + len(MARK), (n,))
    return np.frombuffer(sent.value, np.uint64, n, sent.value.index(MARK) + len(MARK))


@dataclass
class Model:
    """What workers get: filter parts of one round, exact counts of frequent words, and totals."""

    words: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    edges: np.ndarray
    context_edges: np.ndarray
    often: np.ndarray
    often_counts: np.ndarray
    n: int
    v: int
    damping: tuple[float, float]
    texts: int = 0

    def part(self, key: np.ndarray, kind: int) -> np.ndarray:
        """The part of the filter that each key would be in."""
        n = len(self.edges) + 1
        if kind != AFTER:
            return bucket_of(unmix(key) if kind == TRI else key, n)
        plain = unmix(key)  # its upper half is that of AFTER_1's or of AFTER_2's number
        pair = plain >> np.uint64(32) == _SALT[AFTER_2] >> np.uint64(32)
        return np.where(pair, bucket_of((plain ^ _SALT[AFTER_2]) << np.uint64(32), n), n + bucket_of(key, len(self.context_edges) + 1))

    def probe(self, key: np.ndarray, kind: int, part: np.ndarray | None = None) -> np.ndarray:
        """The level of each key: probes of 1, 2, ... until the first miss; 0 for keys of parts that another round holds."""
        found = np.zeros(len(key), np.int8)
        part = self.part(key, kind) if part is None else part
        size = self.size[part]
        active = np.flatnonzero(size)
        if len(active) < len(key):
            key, part, size = key[active], part[active], size[active]
        begin, size, left, q = self.begin[part], size.astype(np.uint64), np.arange(len(key)), 1
        while len(left):
            at, mask = spots(key, kind, q, size)
            hit = (self.words[begin + at] & mask) == mask
            left, key, begin, size = left[hit], key[hit], begin[hit], size[hit]
            found[active[left]] = q
            q += 1
        return found

    def here(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the keys whose part this round holds, and these parts."""
        some = np.flatnonzero(self.size[part])
        return (some, part[some]) if len(some) < len(part) else (some, part)

    def levels(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """(5, tokens): levels of the word, bigram, trigram, and of what follows either context; 0 for what other rounds hold."""
        out = np.zeros((5, len(token)), np.int8)
        pair, triple = plain_keys(token, one, two)
        n = len(self.edges) + 1
        word, mixed = mix(token), mix(pair)
        some, _ = self.here(bucket_of(word, n))
        names, inverse = np.unique(word[some], return_inverse=True)
        out[0, some] = self.probe(names, UNI)[inverse]
        some, part = self.here(bucket_of(mixed, n))
        out[1, some] = self.probe(mixed[some], BI, part)
        some, part = self.here(bucket_of(triple, n))  # what follows two words is in the part of the trigrams
        key = triple[some]
        out[2, some] = self.probe(mix(key), TRI, part)
        out[4, some] = self.probe(mix((key >> np.uint64(32)) ^ _SALT[AFTER_2]), AFTER, part)
        context = mix((pair >> np.uint64(32)) ^ _SALT[AFTER_1])
        some, _ = self.here(n + bucket_of(context, len(self.context_edges) + 1))
        names, inverse = np.unique(context[some], return_inverse=True)
        out[3, some] = self.probe(names, AFTER)[inverse]
        return out

    def exact(self, key: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        if not len(self.often):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.often, key), len(self.often) - 1)
        return np.where(self.often[at] == key, self.often_counts[at], 0)

    def log_probability(self, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
        return log_probability(first, levels, self.n, self.v, self.texts, self.damping)


def log_probability(first: np.ndarray, levels: np.ndarray, n: int, v: int, texts: int, damping: tuple[float, float]) -> np.ndarray:
    """log10 of each token's probability: trigram over bigram over word, each discounted mass going to the next.

    All counts are those that the levels stand for; only the number of tokens, words and texts is known exactly.
    """
    c1, c2, c3, a1, a2 = VALUE[levels.astype(np.int64)]
    head = np.zeros(levels.shape[1], bool)
    head[first[:-1]] = True
    p = (c1 + 0.1) / (n + 0.1 * (v + 1))
    prior, pair = (np.concatenate([[0.0], c[:-1]]) for c in (c1, c2))
    prior[head] = pair[head] = texts
    for seen, follow, context, damp in ((c2, a1, prior, damping[0]), (c3, a2, pair, damping[1])):
        seen = np.where(seen > 0, seen - DISCOUNT, 0)
        follow = np.maximum(follow / 4, seen)
        context = np.maximum(context, follow) + damp
        p = (seen + (context - follow) * p) / context
    return np.log10(p)


def score_texts(
    docs: DataFrame, folds: int = 10, held_out: int = 0, often_words: int = 1 << 20, round_mb: int = 32, damping: tuple[float, float] = (8.0, 1.0), buckets: int | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Texts (null: empty) of the fold ``held_out`` (crc32 of the id as text, modulo ``folds``) are not learned from. Words are told apart by
    64-bit hashes. score comes from probes of the filter alone. A filter of at most ``round_mb`` is broadcast, with exact counts of the ``often_words`` most
    frequent words for base_score, whose other words join by bucket. Keys of the texts go to the parts of a larger one. Words not seen in training get the smoothed mass of a count of zero.
    Repeated rows are scored each, extra columns ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    texts, size = docs.agg(F.coalesce(F.count_if(~F.col("held_out")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a bucket's work is one task's, so buckets grow with the texts; those of single words, which every bucket writes to, with the words alone
    buckets, context_buckets = buckets or max(16, 4 * partitions, size // BUCKET_BYTES), max(16, size // BUCKET_BYTES // 64)
    tables = []
    for k in range(RANGES):
        own = k * buckets // RANGES, (k + 1) * buckets // RANGES
        tables.append(save(count_ngrams(docs.where(~F.col("held_out")).select("text"), buckets, context_buckets, own=own), "ngrams"))
        free_shuffles(spark)
    counted = reduce(DataFrame.unionByName, tables)
    contexts = save(context_parts(counted, buckets), "contexts")
    counts = save(counted.where(F.col("kind") == COUNTS), "words")
    parts = counted.where(F.col("kind") == FILTER).select("bucket", "blob").unionByName(contexts.select("bucket", "blob"))
    sizes = {r.bucket: r.size for r in parts.select("bucket", F.length("blob").alias("size")).collect()}
    sent = sum(sizes.values()) <= round_mb << 20
    n, v, often, often_counts = word_totals(counts, often_words if sent else 0)
    if sent:
        scored = by_broadcast(docs, parts, sizes, counts, Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), bucket_edges(buckets), bucket_edges(context_buckets), often, often_counts, n, v, damping, texts))
    else:
        scored = by_chunks(docs, parts, counts, buckets, context_buckets, n, v, texts, damping)
    for table in (*tables, contexts):
        drop(table)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles that nothing refers to go when the driver collects garbage; what the last call returned is held until the next one."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def by_broadcast(docs: DataFrame, parts: DataFrame, sizes: dict[int, int], counts: DataFrame, model: Model) -> DataFrame:
    """Scores from a filter that the workers get as a whole; counts of words that aren't among the frequent ones join by bucket."""
    spark, own, buckets, n, v = docs.sparkSession, sorted(sizes), len(model.edges) + 1, model.n, model.v
    begin, size = (np.zeros(buckets + len(model.context_edges) + 1, np.int64) for _ in range(2))
    lengths = np.array([sizes[b] // 8 for b in own], np.int64)
    begin[own], size[own] = np.cumsum(lengths) - lengths, lengths
    room, words = filter_room(int(lengths.sum()))
    for some in grouped(sizes, COLLECT_BYTES) if own else ():
        table = parts.where(F.col("bucket").between(some[0], some[-1])).toArrow()
        for b, blob in zip(table.column("bucket").to_pylist(), table.column("blob"), strict=True):
            words[begin[b] : begin[b] + size[b]] = np.frombuffer(blob.as_buffer(), np.uint64)
        del table, blob
        give_back()
    n_words = len(words)
    del words
    sent = spark.sparkContext.broadcast(room), spark.sparkContext.broadcast(replace(model, begin=begin, size=size)), n_words
    del room
    scored = save(docs.mapInArrow(scoring(sent, buckets), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bucket int, kind int, blob binary"), "scores")
    sent[0].destroy()
    sent[1].destroy()
    rare = scored.where("rid is null").select("bucket", "kind", "blob").unionByName(counts)
    known = rare.groupBy("bucket").applyInArrow(rare_counts(n, v), "rid long, base double, n_known long").groupBy("rid").agg(F.sum("base").alias("rare_base"), F.sum("n_known").alias("rare_known"))
    return scored.where("rid is not null").join(known, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score"
    )


def by_chunks(docs: DataFrame, parts: DataFrame, counts: DataFrame, buckets: int, context_buckets: int, n: int, v: int, texts: int, damping: tuple[float, float]) -> DataFrame:
    """Scores from a filter that stays where it is: the keys of a chunk of texts go to their parts, and the levels come back to the chunk.

    What is moved grows with the texts alone, and no task holds more than a bucket or a chunk.
    """
    kept = parts.withColumn("kind", F.lit(FILTER)).unionByName(counts.select("bucket", "blob", "kind")).select(F.col("bucket").cast("long"), F.lit(None).cast("long").alias("chunk"), "kind", "blob")
    cut, found = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(TEXT_SLICES)), []
    for k in range(TEXT_SLICES):
        asked = docs.where(cut == k).mapInArrow(asking(buckets, context_buckets), _ASKED)
        answered = asked.unionByName(kept).groupBy("bucket").applyInArrow(answering(), _ASKED)
        scored = answered.groupBy("chunk").applyInArrow(chunk_scores(n, v, texts, damping), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        found.append(save(scored, "scores"))
        del asked, answered, scored
        free_shuffles(docs.sparkSession)
    return reduce(DataFrame.unionByName, found)


TEXTS = 13
_ASKED = "bucket long, chunk long, kind int, blob binary"


def asked_rows(bucket: list[int], chunk: list[int], kind: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "chunk", "kind", "blob"])


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers with bytes of one place together, which the shuffle's compression likes."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T) for b in blobs]).view(kind).ravel() if blobs else np.zeros(0, kind)


def chunk_keys(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What tokens are looked up by: words, bigrams, trigrams (which their context goes with), and the contexts of one word."""
    pair, triple = plain_keys(token, one, two)
    yield UNI, mix(token)
    yield BI, mix(pair)
    yield AFTER, mix((pair >> np.uint64(32)) ^ _SALT[AFTER_1])
    del pair
    yield TRI, triple


def asking(buckets: int, context_buckets: int, flush: int = 1 << 20):
    """Rows of chunks of texts: by bucket the distinct keys that are looked up there, and the chunk's texts under a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, sink, writer, held = TaskContext.get().partitionId() << 32, 0, None, None, {}
        edges = {kind: bucket_edges(context_buckets if kind == AFTER else buckets) for kind in (UNI, BI, AFTER, TRI)}

        def out() -> Iterator[pa.RecordBatch]:
            writer.close()
            yield asked_rows([-1 - chunk], [chunk], [TEXTS], [sink.getvalue().to_pybytes()])
            for kind in list(held):
                names, _ = counted_sorted(np.concatenate(held.pop(kind)))
                at = np.concatenate([[0], np.searchsorted(names, edges[kind]), [len(names)]])
                some = np.flatnonzero(np.diff(at))
                for few in np.array_split(some, -(-len(some) // 64)):
                    yield asked_rows((few + (buckets if kind == AFTER else 0)).tolist(), [chunk] * len(few), [kind] * len(few), [planes(names[at[b] : at[b + 1]]) for b in few.tolist()])
            give_back()

        for batch in batches:
            for part in slices(batch.select(["doc_id", "held_out", "text"]), "text"):
                if writer is None:
                    writer = pa.ipc.new_stream(sink := pa.BufferOutputStream(), part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(part)
                token, one, two, _ = sequence(Words(part.column("text")))
                for kind, names in chunk_keys(token, one, two):
                    held.setdefault(kind, []).append(counted_sorted(names)[0] if kind in (UNI, AFTER) else names)
                size += len(token)
                if size >= flush:
                    yield from out()
                    chunk, size, writer = chunk + 1, 0, None
        if size:
            yield from out()

    return run


def answering():
    """A bucket's keys meet its part of the filter: levels in the keys' order, with exact counts for words and the level of its context for each trigram."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        bucket, chunk, kind, blob = (rows.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "blob"))
        if group[0].as_py() < 0:
            return rows
        by = {k: [i for i, x in enumerate(kind) if x == k] for k in set(kind)}
        words = np.frombuffer(blob[by[FILTER][0]], np.uint64) if FILTER in by else np.zeros(0, np.uint64)
        none, out, order = np.zeros(0, np.uint64), [], []
        part = Model(words, np.zeros(1, np.int64), np.array([len(words)]), none, none, none, none, 0, 0, (0.0, 0.0))
        level_of = lambda key, k: part.probe(key, k, np.zeros(len(key), np.int64))
        for k in (UNI, BI, AFTER, TRI):
            if k not in by:
                continue
            own = [blob[i] for i in by[k]]
            key, ends = unplaned(own, np.uint64), np.cumsum([len(b) // 8 for b in own])
            if k == TRI:
                head = np.concatenate([[True], (key[1:] ^ key[:-1]) >> np.uint64(32) != 0])
                found = [level_of(mix(key), TRI), level_of(mix((key[head] >> np.uint64(32)) ^ _SALT[AFTER_2]), AFTER)[np.cumsum(head) - 1]]
            else:
                found = [level_of(key, k)]
            if k == UNI:
                names, number = np.frombuffer(blob[by[COUNTS][0]], np.int64).reshape(2, -1) if COUNTS in by else np.zeros((2, 0), np.int64)
                names, at = names.view(np.uint64), np.minimum(np.searchsorted(names.view(np.uint64), key), max(len(names) - 1, 0))
                count = np.where(names[at] == key, number[at], 0) if len(names) else np.zeros(len(key), np.int64)
            for i, s, e in zip(by[k], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out.append(b"".join(x[s:e].tobytes() for x in found) + (planes(count[s:e]) if k == UNI else b""))
                order.append(i)
        del blob, rows
        give_back()
        return pa.Table.from_batches([asked_rows([bucket[i] for i in order], [chunk[i] for i in order], [kind[i] for i in order], out)])

    return run


def chunk_scores(n: int, v: int, texts: int, damping: tuple[float, float]):
    """Scores of a chunk's texts, whose keys are sorted once more, from the levels that came back for them."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind").to_numpy(), rows.column("bucket").to_numpy()
        blob = rows.column("blob").to_pylist()
        of = lambda k: [blob[i] for i in np.flatnonzero(kind == k)[np.argsort(bucket[kind == k])].tolist()]
        joined = lambda pieces: np.frombuffer(b"".join(pieces), np.int8)
        table = pa.ipc.open_stream(of(TEXTS)[0]).read_all()
        runs = [sequence(Words(x)) for x in table.column("text").chunks]
        starts = np.cumsum([0, *(len(r[0]) for r in runs)])
        firsts = [r[3] for r in runs]
        token, one, two = (np.concatenate([r[i] for r in runs]) for i in range(3))
        del runs
        levels = np.zeros((5, len(token)), np.int8)
        for k, key in chunk_keys(token, one, two):
            names, inverse = np.unique(key, return_inverse=True)
            got = of(k)
            if k == UNI:
                levels[0] = joined([b[: len(b) // 9] for b in got])[inverse]
                exact = unplaned([b[len(b) // 9 :] for b in got], np.int64)[inverse]
            elif k == TRI:
                levels[2], levels[4] = (joined(x)[inverse] for x in zip(*((b[: len(b) // 2], b[len(b) // 2 :]) for b in got), strict=True))
            else:
                levels[1 if k == BI else 3] = joined(got)[inverse]
            del names, inverse, key
        n_tokens, known, base, score = [], [], [], []
        for s, e, first in zip(starts[:-1], starts[1:], firsts, strict=True):
            count = exact[s:e]
            n_tokens.append(np.diff(first))
            known.append(np.add.reduceat((count > 0).astype(np.int64), first[:-1]))
            base.append(np.add.reduceat(np.log10((count + 0.1) / (n + 0.1 * (v + 1))), first[:-1]))
            score.append(np.add.reduceat(log_probability(first, levels[:, s:e], n, v, texts, damping), first[:-1]))
        out = pa.table([table.column("doc_id"), table.column("held_out"), *(pa.array(np.concatenate(x)) for x in (n_tokens, known, base, score))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        del token, one, two, levels, exact, blob, rows
        give_back()
        return out

    return run


def grouped(sizes: dict[int, int], room: int) -> list[list[int]]:
    """The buckets in order, in groups of up to ``room`` bytes; one group at least."""
    out, left = [[]], room
    for b, size in sorted(sizes.items()):
        if out[-1] and size > left:
            out.append([])
            left = room
        out[-1].append(b)
        left -= size
    return out


def word_totals(counts: DataFrame, often_words: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of tokens and of distinct words, and the words, at most ``often_words``, of the greatest counts, sorted by key."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                c = np.frombuffer(blob, np.int64).reshape(2, -1)[1]
                k, number = np.unique((np.log2(c) * 8).astype(np.int32), return_counts=True)
                total = np.bincount(np.searchsorted(k, (np.log2(c) * 8).astype(np.int32)), weights=c, minlength=len(k)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(number), pa.array(total)], ["class", "number", "total"])

    rows = counts.mapInArrow(classes, "class int, number long, total long").groupBy("class").agg(F.sum("number").alias("number"), F.sum("total").alias("total")).orderBy(F.desc("class")).collect()
    least, room = None, often_words
    for r in rows:
        if r.number > room:
            break
        least, room = r["class"], room - r.number
    if least is None:
        return sum(r.total for r in rows), sum(r.number for r in rows), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                both = np.frombuffer(blob, np.int64).reshape(2, -1)
                some = both[:, (np.log2(both[1]) * 8).astype(np.int32) >= least]
                yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], ["blob"])

    found = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in counts.mapInArrow(frequent, "blob binary").toArrow().column("blob").to_pylist()], axis=1)
    order = np.argsort(found[0].view(np.uint64))
    return sum(r.total for r in rows), sum(r.number for r in rows), found[0].view(np.uint64)[order], found[1][order]


def received(sent: tuple[Broadcast, Broadcast, int]) -> Model:
    return replace(sent[1].value, words=shared_filter(sent[0], sent[2]))


def scoring(sent: tuple[Broadcast, Broadcast, int], buckets: int, flush: int = 1 << 19):
    """Scores of each text, with the base score over frequent words, and by bucket the rare words that the rest of it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rid, held = received(sent), TaskContext.get().partitionId() << 36, []
        denominator = model.n + 0.1 * (model.v + 1)

        def rows(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            types = {"rid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns and isinstance(columns[c], pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))

        def out() -> Iterator[pa.RecordBatch]:
            names, where = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(names, kind="stable")
            found = list(encoded(names[order], where[order], bucket_edges(buckets), TAIL))
            if found:
                b, kind, blob = zip(*found, strict=True)
                yield rows(bucket=list(b), kind=list(kind), blob=list(blob))

        for batch in batches:
            for part in slices(batch, "text"):
                token, one, two, first = sequence(Words(part.column("text")))
                levels = model.levels(token, one, two)
                exact = model.exact(mix(token))
                own = np.where(exact > 0, np.log10((exact + 0.1) / denominator), 0.0)
                names = rid + np.arange(part.num_rows)
                rid += part.num_rows
                yield rows(
                    rid=names, doc_id=part.column("doc_id"), held_out=part.column("held_out"), n_tokens=np.diff(first), n_known=np.add.reduceat((exact > 0).astype(np.int64), first[:-1]),
                    base=np.add.reduceat(own, first[:-1]), score=np.add.reduceat(model.log_probability(first, levels), first[:-1]),
                )
                rare = np.flatnonzero(exact == 0)
                held.append((mix(token[rare]), np.repeat(names, np.diff(first))[rare]))
                if sum(len(h[0]) for h in held) >= flush:
                    yield from out()
        if held:
            yield from out()

    return run


def rare_counts(n: int, v: int):
    """Each bucket's rare words meet their exact counts: sums by text."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        names, counts, tail = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True):
            if kind == COUNTS:
                both = np.frombuffer(blob, np.int64).reshape(2, -1)
                names, counts = both[0].view(np.uint64), both[1]
            else:
                tail.append(decoded(blob))
        if not tail:
            return pa.table({"rid": pa.array([], pa.int64()), "base": pa.array([], pa.float64()), "n_known": pa.array([], pa.int64())})
        key, rid = (np.concatenate(x) for x in zip(*tail, strict=True))
        at = np.minimum(np.searchsorted(names, key), max(len(names) - 1, 0))
        count = np.where(names[at] == key, counts[at], 0) if len(names) else np.zeros(len(key), np.int64)
        texts, where = np.unique(rid, return_inverse=True)
        base = np.bincount(where, weights=np.log10((count + 0.1) / (n + 0.1 * (v + 1))))
        return pa.table({"rid": pa.array(texts), "base": pa.array(base), "n_known": pa.array(np.bincount(where, weights=count > 0).astype(np.int64))})

    return run
