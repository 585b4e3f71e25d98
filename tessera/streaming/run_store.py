"""Results of a run's cases, written once each: a stream of cases that can be killed and resumed, errors tried again, many small batches made one.

A batch's rows lie in a folder of their own, which a repeated batch replaces; batches of a stream have even numbers, retries odd ones. A case
with a good result in another batch isn't evaluated again. ``compact`` writes each case's last result to one folder, which counts once it is
whole and stands for all batches up to its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.evaluation import CASE_KEY
from tessera.sources.folders import delete, exists, names

Evaluate = Callable[[DataFrame], DataFrame]


class RunStore:
    """``schema`` is that of results (DDL): the key's columns, ``error`` (null if the case ended well) and any others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = tuple(CASE_KEY)):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(int(n.removeprefix(prefix)) for n in names(self.spark, f"{self.path}/{folder}") if n.startswith(prefix) and exists(self.spark, f"{self.path}/{folder}/{n}/_SUCCESS"))

    def batches(self) -> list[int]:
        """Numbers of the batches that were written whole and that no compaction stands for."""
        upto = self._upto()
        return [n for n in self._numbers("batches", "number=") if n > upto]

    def _upto(self) -> int:
        return max(self._numbers("compacted", "upto="), default=-1)

    def rows(self) -> DataFrame:
        """All rows as they were written, with the number of their batch; results of a compaction have its number."""
        read = lambda path, n: self.spark.read.schema(self.schema).parquet(path).withColumn("batch", F.lit(n).cast("long"))
        upto, out = self._upto(), self.spark.createDataFrame([], f"{self.schema}, batch long")
        if upto >= 0:
            out = out.unionByName(read(f"{self.path}/compacted/upto={upto}", upto))
        found = self.batches()
        if found:
            paths = [f"{self.path}/batches/number={n}" for n in found]
            whole = self.spark.read.schema(f"{self.schema}, number long").option("basePath", f"{self.path}/batches").parquet(*paths)
            out = out.unionByName(whole.withColumnRenamed("number", "batch"))
        return out

    def results(self) -> DataFrame:
        """One row per case: its good result, or else its last error."""
        last = Window.partitionBy(*self.key).orderBy(F.col("error").isNotNull(), F.desc("batch"))
        return self.rows().withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank", "batch")

    def append(self, cases: DataFrame, evaluate: Evaluate, number: int) -> None:
        """Evaluates the cases, each once, that have no good result in another batch, and writes them as batch ``number``."""
        done = self.rows().where((F.col("batch") != number) & F.col("error").isNull()).select(*self.key).distinct()
        left = cases.dropDuplicates(self.key).join(done, self.key, "left_anti")
        fields = [c.strip().split()[0] for c in self.schema.split(",")]
        evaluate(left).select(*fields).write.mode("overwrite").parquet(f"{self.path}/batches/number={number}")

    def run(self, cases: DataFrame, evaluate: Evaluate, checkpoint: str) -> StreamingQuery:
        """Evaluates a stream of cases; started again with the same checkpoint, it goes on with the batch that was under way."""
        return cases.writeStream.foreachBatch(lambda batch, n: self.append(batch, evaluate, 2 * n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def retry(self, cases: DataFrame, evaluate: Evaluate) -> None:
        """Evaluates those of the cases again whose only results are errors."""
        failed = self.results().where("error is not null").select(*self.key)
        newest = max([*self._numbers("batches", "number="), self._upto(), -1])
        self.append(cases.join(failed, self.key, "left_semi"), evaluate, newest + 1 + (newest % 2 == 1))

    def compact(self) -> None:
        """Makes all batches one folder of each case's last result, then deletes what it stands for."""
        found, before = self.batches(), self._upto()
        if not found:
            return
        upto = found[-1]
        self.results().write.mode("overwrite").parquet(f"{self.path}/compacted/upto={upto}")
        for n in self._numbers("batches", "number="):
            if n <= upto:
                delete(self.spark, f"{self.path}/batches/number={n}")
        if before >= 0:
            delete(self.spark, f"{self.path}/compacted/upto={before}")
