"""Spelling variants: an even-partition pigeonhole join of words that are one edit apart.

A word of length l is cut into two segments, l // 2 and the rest. One edit leaves one of them as it is, so a word of length l or l + 1 near it
begins with its first segment or ends with its second one. Words are indexed under both and probe for their own and the next smaller length.
Buckets of too many words are cut again: what their words don't share yet is halved by the same rule. Pairs are verified within tasks, and
each link is kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import lowered
from .scratch import drop, save

#: The letters of words.
LETTERS = r"A-Za-zÀ-ÿ"
#: Pairs that are verified at once.
PAIRS = 1 << 16


def garbled(run: Column, key: Column, every: int) -> Column:
    """The run without one code point, where ``every`` divides the checksum of ``<key>:<run>``; else the run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur at least ``twice``; every ``every``-th run of a document by its checksum
    lacks a letter, as a test of the search. Null texts have no words, a null id is written as nothing; equal rows count as often as they come."""
    pattern = F.lit(f"[{LETTERS}]{{{least},}}")  # shorter runs stay short
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("run"))
    found = runs.select(garbled(lowered(F.col("run")), F.col("id"), every).alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= twice)


def keyed(df: DataFrame) -> DataFrame:
    """Adds the bucket's key: the length of indexed words and the letters shared so far at the beginning and at the end."""
    head, tail = F.substring(F.col("word"), F.lit(1), F.col("p")), F.when(F.col("q") > 0, F.expr("right(word, q)")).otherwise("")
    return df.withColumn("key", F.xxhash64("len", "p", "q", head, tail))


def halved(df: DataFrame) -> DataFrame:
    """Each row twice: once for the first, once for the second half of the letters that its bucket's words don't share yet."""
    half = F.floor((F.col("len") - F.col("p") - F.col("q")) / 2).cast("int")
    rest = F.col("len") - F.col("p") - F.col("q") - half
    first, second = F.struct((F.col("p") + half).alias("p"), F.col("q").alias("q")), F.struct(F.col("p").alias("p"), (F.col("q") + rest).alias("q"))
    return df.select("word", "n", "len", F.explode(F.array(first, second)).alias("s")).select("word", "n", "len", "s.p", "s.q")


def buckets(words: DataFrame, most: int) -> DataFrame:
    """(word, n, len, key): a row for each segment of a word of length len, and for the segments a word of length len + 1 probes.

    Buckets of over ``most`` rows are cut until one letter alone isn't shared; then they hold as many words as there are letters, or pairs of
    letters, at most. Every round halves what is left, so rounds are few; what rounds leave is written.
    """
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("len"), F.lit(0).alias("p"), F.lit(0).alias("q")).where("len > 0")
    done, open_ = [], save(keyed(halved(both)), "segments")
    while True:
        large = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first(F.col("len") - F.col("p") - F.col("q")).alias("left")).where((F.col("m") > most) & (F.col("left") > 1))
        large = save(large.select("key"), "large")
        if not large.limit(1).count():
            drop(large)
            done.append(open_)
            break
        done.append(open_.join(large, "key", "left_anti"))
        open_ = save(keyed(halved(open_.join(large, "key", "left_semi").drop("key"))), "segments")
    out = done[0].select("word", "n", "len", "key")
    for more in done[1:]:
        out = out.unionByName(more.select("word", "n", "len", "key"))
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points in rows, filled up with zeros, and their lengths."""
    data = [w.encode("utf-32-le") for w in column.to_pylist()]
    size = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
    width = 4 * int(size.max(initial=0))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.int32).reshape(len(data), -1), size


def one_edit(x: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words a and b, rows of ``x``, differ by one edit; b is as long as a or longer by one."""
    near = np.zeros(len(a), bool)
    longer = size[b] > size[a]
    same = np.flatnonzero(~longer)
    near[same] = (x[a[same]] != x[b[same]]).sum(1) == 1
    more = np.flatnonzero(longer)
    if len(more):
        short, long = x[a[more]], x[b[more]]
        end = size[a[more], None]
        place = np.arange(x.shape[1] - 1)
        stays = np.where(place < end, short[:, :-1] == long[:, :-1], False)
        moved = np.where(place < end, short[:, :-1] == long[:, 1:], True)
        head = np.where(stays.all(1), x.shape[1] - 1, stays.argmin(1))
        tail = np.where(moved.all(1), x.shape[1] - 1, moved[:, ::-1].argmin(1)) - (x.shape[1] - 1 - end[:, 0])
        near[more] = head + tail >= end[:, 0]
    return near


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows of a bucket; rows come in order of bucket, the last bucket of a batch waits for the next batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        held = rows.slice(cut)
        if cut:
            yield from links(rows.slice(0, cut))
    if held is not None:
        yield from links(held)


def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of rows in whole buckets, by numbers of indexed length, so that one very long word widens no others."""
    for of in np.unique(rows.column("len").to_numpy()).tolist():
        part = rows.filter(pa.array(rows.column("len").to_numpy() == of)).combine_chunks()
        word, n, key = part.column("word").combine_chunks(), part.column("n").to_numpy(), part.column("key").to_numpy()
        x, size = letters(word)
        n_rows = len(key)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.repeat(np.append(begin[1:], n_rows), np.diff(np.append(begin, n_rows)))
        step, left = 1, np.arange(n_rows)
        while True:
            left = left[left + step < end[left]]
            if not len(left):
                break
            for i in range(0, len(left), PAIRS):
                a, b = left[i : i + PAIRS], left[i : i + PAIRS] + step
                a, b = np.where(size[a] > size[b], b, a), np.where(size[a] > size[b], a, b)
                some = size[a] == of  # two words of the greater length are for the buckets of that length
                a, b = a[some], b[some]
                ok = one_edit(x, a, b, size)
                a, b = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]])
                if len(a):
                    yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), pa.array(n[b])], ["word", "near", "near_n"])
            step += 1


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round, until no root has a form."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = save(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(at)
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        at = new.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, most: int = 128) -> DataFrame:
    """One row per row of ``words`` (word, n), of which words are distinct: word, n, form, root, n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of largest n, ties to the first in order of
    code points, if its n is at least ``ratio`` times the word's; null otherwise. Rows with a null word take no part. An empty table gives an
    empty one.
    """
    words = save(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "words")
    dealt = buckets(words, most).repartition("key").sortWithinPartitions("key")
    pairs = save(dealt.mapInArrow(verified, "word string, near string, near_n long").distinct(), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near"))
    rated = save(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "rated")
    root = roots(rated.where("form is not null"))
    return rated.join(root, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
