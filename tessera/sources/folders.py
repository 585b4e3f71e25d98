"""Folders by Spark's own filesystem: which are there, and how they go."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    fs, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder with all in it; whether it was there."""
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.delete(where, True)
