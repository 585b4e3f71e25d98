"""CSV files as typed tables: all cells as text first, then one vote on the decimal mark of each column, then numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import decimal_comma_vote, read_number
from tessera.functions.texts import markdown_row

from .sections import sheets


def typed(raw: DataFrame, separator: str = ",") -> DataFrame:
    """Text columns whose filled cells are all numbers become doubles; in the others each number is written plainly and text stays.

    The column's own spellings decide whether the comma is its decimal mark; without evidence a file separated by semicolons has
    decimal commas and one separated by commas doesn't. One aggregation over the data finds all of this. No filled cell is lost:
    a mixed column (7, 007, n/a) stays text, and plans read the numbers in it.
    """
    fallback = {";": True, ",": False}.get(separator)
    facts = []
    for c in raw.columns:
        x = F.col(f"`{c}`")
        rest = lambda comma, x=x: F.count_if((F.trim(x) != "") & read_number(x, comma).isNull())  # noqa: E731 - cells that are no numbers
        facts.append(F.struct(decimal_comma_vote(x).alias("vote"), F.count_if(F.trim(x) != "").alias("filled"), *(rest(k).alias(name) for name, k in (("comma", True), ("dot", False), ("none", None)))).alias(c))
    found, out = raw.agg(*facts).first(), []
    for c in raw.columns:
        x, fact = F.col(f"`{c}`"), found[c]
        comma = fallback if fact.vote is None else fact.vote
        number, rest = read_number(x, comma), {True: fact.comma, False: fact.dot, None: fact.none}[comma]
        whole = number == F.floor(number)
        shown = F.when(whole & (F.abs(number) < 1e15), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
        out.append((number if fact.filled and not rest else F.when(number.isNotNull(), shown).when(F.trim(x) != "", x)).alias(c))
    return raw.select(*out)


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    raw = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return typed(raw, separator)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, place, number, cells, formulas): rows of the workbooks below ``path``, sheets and rows counted from 0, with the sheet's number of formulas, whose
    cached values are read; an empty sheet has one row with null cells. All rows are read, however many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                for place, (sheet, grid, formulas) in enumerate(sheets(data)):
                    yield pd.DataFrame({"path": name, "sheet": sheet, "place": place, "number": range(max(len(grid), 1)), "cells": grid or [None], "formulas": formulas})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, place int, number int, cells array<string>, formulas int")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, sheet, rows, formulas): the sheets of workbooks with their numbers of rows, the header's too, and of formulas."""
    return workbook_rows(spark, path).groupBy("path", "place", "sheet").agg(F.count("cells").alias("rows"), F.max("formulas").alias("formulas"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's sheet of that name (its first with cells, if none is given) as a typed table; ValueError if there is no such sheet or no cell.

    Columns are named by the first row: unnamed ones and repeated names by their place.
    """
    rows = workbook_rows(spark, path).where("cells is not null")
    head = (rows if sheet is None else rows.where(F.col("sheet") == sheet)).where("number = 0").orderBy("place").first()
    if head is None:
        raise ValueError(f"The workbook has no sheet {sheet} with cells." if sheet else "The workbook holds no cells.")
    names: list[str] = []
    for i, name in enumerate(head.cells, 1):
        names.append(name.strip() if name.strip() and name.strip().lower() not in (n.lower() for n in names) else f"column {i}")
    body = rows.where((F.col("place") == head.place) & (F.col("number") > 0))
    return typed(body.select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names))), "")


def table_info(df: DataFrame, rows: int = 5, position: list[str] | None = None) -> tuple[list[str], int, DataFrame]:
    """Columns, number of rows, and the first rows by ``position`` (any, if not given)."""
    first = df.orderBy(*position) if position else df
    return df.columns, df.count(), first.limit(rows)


def csv_sections(spark: SparkSession, path: str, separator: str = ",", rows_each: int = 100) -> DataFrame:
    """(path, section_id, title, locator, markdown) of CSV files of the same columns, in sections of ``rows_each`` rows as Markdown tables.

    For large files, which Spark splits (so cells hold no line breaks): rows are counted by split, and numbered from the splits before
    theirs. Blank rows are left out; a file of a header alone has one section. ``sources.sections`` reads small files of any form.
    """
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    names = raw.columns
    rows = raw.select(*(F.col(f"`{c}`") for c in names), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    rows = rows.where(" or ".join(f"trim(coalesce(`{c}`, '')) <> ''" for c in names))
    splits = rows.groupBy("__path", "__split").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__path").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("__path"))
    place = F.row_number().over(Window.partitionBy("__path", "__split").orderBy("__id"))
    numbered = rows.withColumn("place", place).join(splits.select("__path", "__split", before.alias("before"), total.alias("total")), ["__path", "__split"]).withColumn("number", F.col("before") + F.col("place") - 1)
    line = markdown_row([F.col(f"`{c}`") for c in names])
    by_section = numbered.withColumn("section", F.floor(F.col("number") / rows_each)).groupBy("__path", "section", "total").agg(F.sort_array(F.collect_list(F.struct("number", line.alias("line")))).alias("lines"))
    head = "| " + " | ".join(c.replace("|", "\\|") for c in names) + " |\n|" + " --- |" * len(names)
    locator = F.concat(F.lit("Rows "), (F.col("section") * rows_each + 1).cast("string"), F.lit("-"), F.least((F.col("section") + 1) * rows_each, F.col("total")).cast("string"))
    found = by_section.select(F.col("__path").alias("path"), (F.col("section") + 1).cast("int").alias("section_id"), locator.alias("locator"), F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("markdown"))
    files = spark.read.format("binaryFile").load(path).select("path")
    alone = files.join(found.select("path").distinct(), "path", "left_anti").select("path", F.lit(1).alias("section_id"), F.lit("Header only").alias("locator"), F.lit(head).alias("markdown"))
    return found.unionByName(alone).select("path", "section_id", F.col("locator").alias("title"), "locator", "markdown")
