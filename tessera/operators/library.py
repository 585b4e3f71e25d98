"""A library of documents as a table: load, add, edit, delete, list, and documents by id in a given order. Every change is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.texts import file_name

SCHEMA = "doc_id string, name string, kind string, status string, markdown string, character_count long, token_count long, imported_at timestamp"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON files, one object each or by line; broken files and those without an id are left out."""
    raw = spark.read.schema(f"{SCHEMA}, broken string").option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)
    return raw.where("broken is null and doc_id is not null").drop("broken")


def added(library: DataFrame, texts: DataFrame, kind: str = "text") -> DataFrame:
    """The library with pasted (or fetched) texts: (doc_id, name, markdown, imported_at). Names are made safe, "Pasted text" if there is none;
    empty texts are left out."""
    name = F.coalesce(F.nullif(file_name(F.coalesce("name", F.lit(""))), F.lit("")), F.lit("Pasted text"))
    new = texts.where(F.trim(F.coalesce("markdown", F.lit(""))) != "").select(
        "doc_id", name.alias("name"), F.lit(kind).alias("kind"), F.lit("ready").alias("status"), "markdown", F.length("markdown").cast("long").alias("character_count"), F.lit(None).cast("long").alias("token_count"), "imported_at"
    )
    return library.unionByName(new, allowMissingColumns=True)


def updated(library: DataFrame, edits: DataFrame) -> DataFrame:
    """The library with edited texts (doc_id, markdown): characters are counted anew, tokens are unknown again."""
    met = library.join(edits.select("doc_id", F.col("markdown").alias("__new")), "doc_id", "left")
    changed = F.col("__new").isNotNull()
    return met.withColumns(
        {"character_count": F.when(changed, F.length("__new").cast("long")).otherwise(F.col("character_count")), "token_count": F.when(~changed, F.col("token_count")), "markdown": F.coalesce("__new", "markdown")}
    ).select(*library.columns)


def with_token_counts(library: DataFrame, counts: DataFrame) -> DataFrame:
    """The library with counted tokens (doc_id, token_count); documents without a count keep theirs."""
    met = library.join(counts.select("doc_id", F.col("token_count").alias("__counted")), "doc_id", "left")
    return met.withColumn("token_count", F.coalesce("__counted", "token_count")).select(*library.columns)


def deleted(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*library.columns)


def oldest_first() -> list[Column]:
    return [F.col("imported_at"), F.col("doc_id")]


def by_ids(library: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, place, doc_id, found and the library's columns): documents of each list of ids (set_id, doc_ids), in the list's order; unknown ids stay, not found."""
    asked = wanted.select("set_id", F.posexplode("doc_ids").alias("place", "doc_id"))
    return asked.join(library.withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ready(selection: DataFrame) -> DataFrame:
    return selection.where("status = 'ready'")
