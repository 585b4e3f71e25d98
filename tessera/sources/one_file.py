"""A sink of one file with a chosen name: tasks write their parts aside, a commit puts them together, an abort leaves nothing.

The file appears under its name when it is whole, by a rename; a file that was there stays until then. Parts that lost attempts wrote are not in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import safe_cells
from .source import filesystem

#: Bytes that are copied at once when parts are put together.
COPIED = 8 << 20
BOM = "﻿"


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class OneFileWriter(DataSourceWriter):
    """Rows of one text column as lines; ``head`` comes before them, ``end`` after each."""

    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.end = options["path"], options.get("head", ""), options.get("end", "\n")
        _, self.inner, _ = filesystem(self.path)
        self.aside = f"{self.inner}.parts-{uuid.uuid4().hex}"

    def filesystem(self) -> pyarrow.fs.FileSystem:
        return filesystem(self.path)[0]

    def write(self, rows: Iterator[Row]) -> Part:
        task, fs = TaskContext.get(), self.filesystem()
        fs.create_dir(self.aside, recursive=True)
        part = f"{self.aside}/{task.partitionId()}-{task.taskAttemptId()}"
        with fs.open_output_stream(part) as out:
            for row in rows:
                out.write(((row[0] or "") + self.end).encode())
        return Part(task.partitionId(), part)

    def commit(self, messages: list[Part | None]) -> None:
        fs, whole = self.filesystem(), f"{self.aside}.whole"
        with fs.open_output_stream(whole) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with fs.open_input_stream(part.path) as one:
                    while data := one.read(COPIED):
                        out.write(data)
        fs.move(whole, self.inner)
        self.clear(fs)

    def abort(self, messages: list[Part | None]) -> None:
        self.clear(self.filesystem())

    def clear(self, fs: pyarrow.fs.FileSystem) -> None:
        if fs.get_file_info(self.aside).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self.aside)
        if fs.get_file_info(f"{self.aside}.whole").type == pyarrow.fs.FileType.File:
            fs.delete_file(f"{self.aside}.whole")


class OneFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema: StructType, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options)


def _quoted(c):
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column of CSV lines, cells as ``safe_cells`` makes them, quoted where they must be."""
    safe = safe_cells(df)
    return safe.select(F.array_join(F.array(*(_quoted(F.col(f"`{c}`")) for c in safe.columns)), ",").alias("line"))


def write_csv_file(df: DataFrame, path: str) -> None:
    """A CSV file of that name, with a byte-order mark and a header, for spreadsheets; rows in the order of ``df``."""
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c
    head = BOM + ",".join(quote(c) for c in df.columns) + "\r\n"
    csv_lines(df).write.format("one_file").option("path", path).option("head", head).option("end", "\r\n").mode("overwrite").save()


def write_text_file(df: DataFrame, path: str, column: str = "text") -> None:
    """A text file (Markdown, LaTeX) of that name: the column's texts, a line feed after each."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("line")).write.format("one_file").option("path", path).option("end", "\n").mode("overwrite").save()
