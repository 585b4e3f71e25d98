"""Written intermediates: lineage is cut with Parquet tables in the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; a local one only in local mode, where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows may be blobs of megabytes, so sizes are looked at after every row: pages and row groups stay near their limits.
WRITING = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 100, "parquet.block.size": 32 << 20}


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and returns it as read again, so that later jobs start from files all executors share."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**WRITING).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``save`` returned and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that no column of a table has, letter case aside."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
