"""CSV files of any size whose cells may hold line breaks: split anywhere, cut into records without a pass from the start.

Files are read as lines in splits that Spark chooses. A line break ends a record if the quotes before it, from the file's start, are
even in number; so each split counts its quotes, sums over the splits before give every line its parity, and records get numbers by a
second sum. Only counts by split meet in one place; cells stay where they were read until their record is put together.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a file from which the separator is guessed.
SNIFFED = 20_000
#: Records that are numbered together.
NUMBERED = 100_000


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first file's first 20,000 characters: what csv.Sniffer finds, else the commonest on the first line."""
    lines = spark.read.text(path).limit(2000).collect()
    sample = "\n".join(r.value for r in lines)[:SNIFFED]
    try:
        return csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=sample.split("\n", 1)[0].count)


def lines_of(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """(path, split, id, value, quotes): lines with the split that they begin in, their order in it and their number of quotes."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    raw = raw.withColumnsRenamed({"file_path": "path", "file_block_start": "split"}).withColumn("id", F.monotonically_increasing_id())
    return raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))))


def with_sums_before(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the sum of ``column`` over all earlier rows of the file: sums by split first, then within each split."""
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("path", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "split").agg(F.sum(column).alias("own")).select("path", "split", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))
    met = rows.join(splits, ["path", "split"])
    return met.withColumn(name, F.col("earlier") + F.coalesce(F.sum(column).over(within), F.lit(0))).drop("earlier")


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(path, number, text): the records of CSV files below ``path``, numbered from 0 in each file, blank ones too.

    Line feeds and carriage returns before them end records outside of quotes and stay within. A quote that is never closed runs to the end of the file.
    """
    rows = with_sums_before(lines_of(spark, path, quote), "quotes", "before")
    ends = rows.withColumn("ends", ((F.col("before") + F.col("quotes")) % 2 == 0).cast("long"))
    numbered = with_sums_before(ends, "ends", "number")
    # A record's lines are few; the largest is the longest cell's.
    parts = F.sort_array(F.collect_list(F.struct("split", "id", "value")))
    whole = numbered.groupBy("path", "number").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"))
    return whole.withColumn("text", F.regexp_replace("text", "\r$", ""))


def cells(df: DataFrame, separator: str, quote: str = '"') -> DataFrame:
    """(path, number, cells array<string>) of records, read by Python's csv rules; a record that these refuse is one cell."""

    def one(text: str) -> list[str]:
        try:
            return next(csv.reader(io.StringIO(text), delimiter=separator, quotechar=quote), [])
        except csv.Error:
            return [text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            found = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("number"), pa.array(found, pa.list_(pa.string()))], ["path", "number", "cells"])

    return df.select("path", "number", "text").mapInArrow(run, "path string, number long, cells array<string>")


def read_cells(spark: SparkSession, path: str, separator: str | None = None, quote: str = '"') -> DataFrame:
    """(path, number, cells) of all records that hold a filled cell, numbered in their file; the separator is guessed if none is given.
    Each file's first is its header, number 0."""
    found = cells(records(spark, path, quote), separator or sniff_separator(spark, path), quote).where(F.exists("cells", lambda c: c.rlike(r"(?U)\S")))
    placed = found.select("path", F.floor(F.col("number") / NUMBERED).alias("split"), F.col("number").alias("id"), "cells", F.lit(1).cast("long").alias("one"))
    return with_sums_before(placed, "one", "number").select("path", "number", "cells")


def read_split_table(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A table of text columns named by the first file's header: short rows are filled with nulls, longer ones cut. ``tables.typed`` types it."""
    found = read_cells(spark, path, separator)
    head = found.where("number = 0").orderBy("path").first()
    if head is None:
        raise ValueError("The file holds no rows.")
    return found.where("number > 0").select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(head.cells)))


def split_csv_sections(spark: SparkSession, path: str, separator: str | None = None, rows_each: int = 100) -> DataFrame:
    """(path, section_id, title, locator, markdown): what ``sections.read_csv`` gives for each file, in sections of ``rows_each`` rows as
    Markdown tables under the file's header; a file of a header alone has one section, a file without filled cells none."""
    found = read_cells(spark, path, separator)
    clean = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    heads = found.where("number = 0").select("path", F.size("cells").alias("width"), F.col("cells").alias("head"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: clean(F.get(c, i))), " | "), F.lit(" |"))
    rows = found.where("number > 0").join(heads.select("path", "width"), "path").select("path", "number", F.floor((F.col("number") - 1) / rows_each).alias("section"), line(F.col("cells")).alias("line"))
    bodies = rows.groupBy("path", "section").agg(F.max("number").alias("last"), F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]).alias("lines"))
    top = F.concat(line(F.col("head")), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))
    both = heads.select("path", top.alias("top")).join(bodies, "path", "left")
    at = F.coalesce(F.concat(F.lit("Rows "), (F.col("section") * rows_each + 1).cast("string"), F.lit("-"), F.col("last").cast("string")), F.lit("Header only"))
    return both.select("path", (F.coalesce("section", F.lit(0)) + 1).cast("int").alias("section_id"), at.alias("title"), at.alias("locator"), F.concat_ws("\n", "top", F.array_join("lines", "\n")).alias("markdown"))
