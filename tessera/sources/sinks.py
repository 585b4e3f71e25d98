"""Results as files: spreadsheets-safe CSV, Markdown tables, text; all written by executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import csv_safe
from tessera.functions.texts import markdown_row


def safe_cells(df: DataFrame) -> DataFrame:
    """All columns as text: null is empty, formula-like cells get an apostrophe."""
    return df.select(*(csv_safe(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    safe_cells(df).write.option("header", True).csv(path)


def write_text(df: DataFrame, path: str, column: str = "text", ending: str = "md") -> None:
    """Texts as files, one row after another in each; the files end in ``ending`` (md or txt)."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.option("extension", ending).text(path)


def markdown_rows(df: DataFrame, name: str = "line") -> DataFrame:
    """One Markdown table line for each row."""
    return df.select(markdown_row([F.col(f"`{c}`") for c in df.columns]).alias(name))


def full_markdown(sections: DataFrame) -> DataFrame:
    """(doc_id, full_markdown, character_count): sections under headings of their locator and, if it says more, title."""
    title = F.coalesce("title", F.lit(""))
    heading = F.when((title != "") & (title != F.col("locator")), F.concat_ws(" - ", "locator", title)).otherwise(F.col("locator"))
    part = F.concat(F.lit("## "), heading, F.lit("\n\n"), F.trim("markdown"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", part.alias("part")))), lambda s: s["part"]), "\n\n")
    return sections.groupBy("doc_id").agg(joined.alias("full_markdown")).withColumn("character_count", F.length("full_markdown"))
