"""Incremental work on streams: new documents scanned as they come, and a run of cases that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.evaluation import CASE_KEY


def scan_stream(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to each micro-batch of a stream of documents and appends its rows as Parquet.

    A batch that is run again after a failure writes to the same folder, so its rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_results(results: DataFrame, time: str, within: str) -> DataFrame:
    """A stream of case results with each case's first alone; keys are kept for as long as the watermark lasts."""
    return results.withWatermark(time, within).dropDuplicatesWithinWatermark(CASE_KEY)
