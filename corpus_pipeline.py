"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing of sources, packing into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lines import dedup_lines
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.scratch import read, scratch_path, unused
from tessera.llm.simhash import simhash_components

#: Rows are whole texts: batches for Python end at so many bytes (Arrow's own limits are 10,000 rows and 64 MB, in the JVM and again in Python).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit; it holds when a stage's result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts.

    Null and empty texts get the score of no words and stay or go by it; rows repeated under an id are judged each by their own text. An
    empty table gives an empty one.
    """
    small_batches(spark)
    return quality_scores(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one; a document that had words and has none left goes.

    Null texts stay null, blank lines stay, documents without an id are left alone; rows repeated under an id lose the same lines.
    n_chars, if there is such a column, is counted anew for changed texts.
    """
    small_batches(spark)
    done = dedup_lines(docs, min_words=1)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates.

    Null and empty texts are one group, with all texts of the same fingerprint; rows repeated under the kept id stay as often as they
    came, and so do rows without an id.
    """
    small_batches(spark)
    groups = simhash_components(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that the sources' words meet the target weights.

    A null source is one of its own, last; texts without words count for nothing and are taken by their source's rate alone; a document is
    taken 0, 1 or 2 times, fixed by its id, and rows repeated under an id alike.
    """
    taken = mixed(docs).where("copies > 0")
    (copy,) = unused(taken.columns, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all into sequences of 2048 tokens; null and empty texts are their end mark alone, longer texts are cut into pieces."""
    small_batches(spark)
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", packing)]

#: Training, hashing and searching have no equivalent in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
