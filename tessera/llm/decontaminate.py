"""Benchmark decontamination: a prefix-filtered set join of word shingles, in DataFrame functions alone.

A window is ``size`` consecutive words of an item (all words of a shorter item). Its token set are its shingles of ``shingle`` words. As a
window must be contained whole, one shingle is a sufficient prefix: the rarest by its count over all documents. Windows of which a shingle
stands in no document are out. Documents' shingles join with these prefix shingles only; a meeting fixes where the window would begin, which
the length and position bounds test before its words are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save

#: What separates words, after the letters A-Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a table, by its counted rows and characters, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def lowered(text: Column) -> Column:
    """The text with A-Z as a-z and all else as it is; ASCII texts take the quicker function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text, none of a null one."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAKS), "")


def shingle_key(w: Column, at: Column, n: int) -> Column:
    """A number for the ``n`` words from position ``at`` (from 0); equal numbers are a hint only."""
    return F.xxhash64(F.lit(n), *(F.get(w, at + i) for i in range(n)))


def benchmark_windows(items: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (wid, win, len) of distinct windows, and (wid, item) of the items that hold them. Items without an id hold theirs too,
    but are not listed."""
    w = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - size, F.lit(0)) + 1)
    cut = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("win"))
    held = save(cut.distinct(), "held")
    windows = save(held.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("len")), "windows")
    listed = save(held.where("item is not null").join(windows, "win").select("wid", "item"), "listed")
    drop(held)
    return windows, listed


def fits(df: DataFrame, chars: Column, most: int) -> bool:
    """Whether the rows of ``df``, at 64 bytes each besides ``chars`` characters, stay within ``most`` bytes."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return 64 * rows + 4 * total <= most


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def overlaps(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, shingle: int = 5, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words (int), n_hit (long), items (sorted array of the ids, as text, of items with a window in
    the document), spans (array of (begin, end) in words, end not included).

    Null and empty texts, and texts and items of separators alone, have no words and no hits. Items of under ``size`` words are one window.
    Repeated items count once, items without an id add hits but are not listed; rows repeated under an id are each judged by their own text,
    equal rows once and given out as often as they came. Extra columns are ignored. An empty table of documents gives an empty one, an empty
    one of items hits nothing. Tables of prefixes are broadcast up to ``broadcast_bytes``; above, the shingles of documents move to them.
    """
    windows, listed = benchmark_windows(items, item_key, item_text, size)
    lengths = [r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("n")).distinct().collect()]  # at most ``shingle`` numbers

    at = F.explode(F.sequence(F.lit(0), F.col("len") - F.least("len", F.lit(shingle)))).alias("off")
    key_of = F.coalesce(*(F.when(F.least("len", F.lit(shingle)) == n, shingle_key(F.col("win"), F.col("off"), n)) for n in lengths), F.lit(0).cast("long"))
    parts = windows.select("wid", "win", "len", at).select("wid", "off", key_of.alias("h"))
    keys = save(parts.select("h").distinct(), "keys")

    tokens = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), words(F.col(text)).alias("w")).withColumn("n", F.size("w"))

    def shingles(first: int) -> DataFrame:
        """A row per position, from ``first`` on, and length of shingle; h is null where none begins. Position -1 stands for the document."""
        each = tokens.where(F.col("n") > first).select("*", F.explode(F.sequence(F.lit(first), F.col("n") - 1)).alias("pos"))
        hs = [F.when((F.col("pos") >= 0) & (F.col("pos") + n <= F.col("n")), shingle_key(F.col("w"), F.col("pos"), n)) for n in lengths]
        none = F.lit(None).cast("long")
        several = F.explode(F.when(F.col("pos") == -1, F.array(none)).otherwise(F.array(*hs))) if len(hs) > 1 else None
        h = several if several is not None else hs[0] if hs else none
        return each.select("*", h.alias("h"))

    counted = shingles(0).select("h").join(hinted(keys, fits(keys, F.lit(0), broadcast_bytes)), "h").groupBy("h").count()
    rated = parts.join(save(counted, "counts"), "h", "left").groupBy("wid")
    rarest = rated.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "h")).alias("r")).where("r.count > 0")
    prefixes = save(windows.join(rarest, "wid").select("wid", "win", "len", F.col("r.off").alias("off"), F.col("r.h").alias("h")), "prefixes")
    small = fits(prefixes, F.length(F.concat_ws(" ", "win")) + 16 * F.col("len"), broadcast_bytes)

    begin = F.col("pos") - F.col("off")
    inside = (begin >= 0) & (begin + F.col("len") <= F.col("n"))
    same = F.slice("w", F.col("begin") + 1, F.col("len")) == F.col("win")
    place = ["id", "th", "n", "begin", "len", "wid"]
    if small:
        met = shingles(-1).join(F.broadcast(prefixes), "h", "left").withColumn("begin", F.when(inside, begin))
        found = met.where((F.col("pos") == -1) | same).select(*place)
    else:
        met = shingles(0).select("id", "th", "n", "pos", "h").join(prefixes.drop("win"), "h").withColumn("begin", begin).where(inside)
        met = met.join(windows.select("wid", "win"), "wid").select("id", "th", "begin", "len", "wid", "win").distinct()
        whole = tokens.alias("t").join(met.alias("m"), F.expr("t.id <=> m.id and t.th = m.th")).select("t.*", "m.begin", "m.len", "m.wid", "m.win").where(same).select(*place)
        found = tokens.select("id", "th", "n", *(F.lit(None).cast("long" if c == "wid" else "int").alias(c) for c in place[3:])).unionByName(whole)
    found = found.groupBy(*place).agg(F.count(F.lit(1)).alias("copies"))

    before = Window.partitionBy("id", "th").orderBy("begin", "len", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("len")
    new = found.withColumn("from", F.greatest("begin", F.max(end).over(before))).withColumn("to", end)
    gain = F.struct("from", "to")
    merged = F.aggregate(
        F.array_sort("pieces"),
        F.expr("cast(array() as array<struct<begin: int, end: int>>)"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] == x["from"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), x["to"].alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["from"].alias("begin"), x["to"].alias("end"))))),
    )
    whole = save(
        new.groupBy("id", "th").agg(
            F.max("n").alias("n_words"), F.sum(F.when(F.col("begin").isNull(), F.col("copies"))).alias("copies"), F.coalesce(F.sum(F.greatest(F.col("to") - F.col("from"), F.lit(0))), F.lit(0)).alias("n_hit"),
            F.collect_set("wid").alias("wids"), F.collect_list(F.when(F.col("to") > F.col("from"), gain)).alias("pieces"),
        ), "overlaps",
    )
    named = whole.select("id", "th", F.explode("wids").alias("wid")).join(hinted(listed, fits(listed, F.length("item"), broadcast_bytes)), "wid")
    named = named.groupBy("id", "th").agg(F.collect_set("item").alias("items"))
    out = whole.alias("a").join(named.alias("b"), F.expr("a.id <=> b.id and a.th = b.th"), "left")
    out = out.select("a.*", F.array_sort(F.coalesce("b.items", F.expr("cast(array() as array<string>)"))).alias("items"), merged.alias("spans"))
    return out.select(F.col("id").alias(key), "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``overlaps`` as a digest: ``key``, n_words, n_hit, n_items, items_sha256 (of the ids, comma-joined; of nothing, where there are none),
    contaminated."""
    found = overlaps(docs, items, **options)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        found.columns[0], F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
