"""A library of documents that lasts: files in buckets by document id, of which a change rewrites only those that it touches.

Every bucket holds a row without an id, so that a bucket whose last document goes is rewritten too. A change writes its buckets aside and puts
them in place when all are whole (dynamic partition overwrite); one that fails before leaves the library as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import exists

from . import library


class StoredLibrary:
    """Documents in the columns of ``library.SCHEMA``; ``buckets`` stays the same for a library's whole life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def create(self, docs: DataFrame | None = None) -> None:
        """Writes all buckets, with documents or empty; what was there goes."""
        none = self.spark.createDataFrame([], library.SCHEMA)
        self._write(none if docs is None else none.unionByName(docs, allowMissingColumns=True), list(range(self.buckets)))

    def _write(self, docs: DataFrame, buckets: list[int]) -> None:
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        rows = docs.withColumn("bucket", self._bucket()).unionByName(marks, allowMissingColumns=True)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            self.create()
        return self.spark.read.schema(f"{library.SCHEMA}, bucket int").parquet(self.path).where("doc_id is not null")

    def documents(self) -> DataFrame:
        return self._read().drop("bucket")

    def _change(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the buckets of the ids; the driver sees bucket numbers alone."""
        touched = sorted(r.bucket for r in ids.where("doc_id is not null").select(self._bucket()).distinct().collect())
        if touched:
            self._write(change(self._read().where(F.col("bucket").isin(touched)).drop("bucket")), touched)

    def add(self, texts: DataFrame, kind: str = "text") -> None:
        """Adds texts (doc_id, name, markdown, imported_at); a document that is there under the same id is replaced."""
        self._change(texts, lambda docs: library.added(library.deleted(docs, texts), texts.where("doc_id is not null"), kind))

    def update(self, edits: DataFrame) -> None:
        """Puts in edited texts (doc_id, markdown), one for each document; unknown ids change nothing."""
        self._change(edits, lambda docs: library.updated(docs, edits))

    def set_token_counts(self, counts: DataFrame) -> None:
        self._change(counts, lambda docs: library.with_token_counts(docs, counts))

    def delete(self, ids: DataFrame) -> int:
        """Takes documents out; how many there were."""
        found = self._read().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").count()
        self._change(ids, lambda docs: library.deleted(docs, ids))
        return found

    def clear(self) -> int:
        found = self._read().count()
        self.create()
        return found
