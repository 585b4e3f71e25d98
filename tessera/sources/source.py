"""Files as a Spark data source: ``spark.read.format("sections")`` and ``spark.readStream.format("sections")`` over a folder.

``register(spark)`` makes it known. Options: ``path`` (a folder or file, of any filesystem that pyarrow opens), ``pattern`` (of file names), ``partitionBytes``.
Filters on ``path`` that Spark pushes (=, in, starts with, ends with; where spark.sql.python.filterPushdown.enabled is set) choose the files before any is opened.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .sections import SCHEMA, file_sections


@dataclass
class Files(InputPartition):
    """Paths that one task reads, as Spark names them."""

    paths: tuple[str, ...]


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The filesystem of a path, the path in it, and what Spark writes before it."""
    if "://" in path:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        return fs, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"), "file:"


def listed(path: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files below a path, by name; hidden ones are left out."""
    fs, inner, before = filesystem(path)
    info = fs.get_file_info(inner)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True, allow_not_found=True))
    names = [f for f in found if f.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))]
    return sorted((before + f.path, f.size or 0, f.mtime_ns or 0) for f in names)


def dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Files in partitions of up to ``most`` bytes; a larger file is one of its own."""
    out, held, size = [], [], 0
    for path, n, _ in files:
        if held and size + n > most:
            out, held, size = [*out, Files(tuple(held))], [], 0
        held, size = [*held, path], size + n
    return [*out, Files(tuple(held))] if held else out


def sections_of(paths: Iterable[str]) -> Iterator[tuple]:
    """Sections of files, one file in memory at a time; one that can't be opened is a row with its error."""
    for path in paths:
        fs, inner, _ = filesystem(path)
        try:
            with fs.open_input_stream(inner) as stream:
                data = stream.read()
        except OSError as error:
            yield (path, 0, None, None, None, str(error))
            continue
        yield from file_sections(path, data)


def path_test(f: Filter) -> Callable[[str], bool] | None:
    """What a pushed filter asks of a path; None if it isn't about paths."""
    if getattr(f, "attribute", None) != ("path",):
        return None
    return {
        EqualTo: lambda p: p == f.value, In: lambda p: p in f.value, StringStartsWith: lambda p: p.startswith(f.value), StringEndsWith: lambda p: p.endswith(f.value),
    }.get(type(f))


class SectionsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("partitionBytes", 32 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if path_test(f) is None:
                yield f
            else:
                self.tests.append(f)

    def partitions(self) -> list[Files]:
        return dealt([f for f in listed(self.path, self.pattern) if all(path_test(t)(f[0]) for t in self.tests)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from sections_of(partition.paths) if partition else ()


class SectionsStream(DataSourceStreamReader):
    """New and changed files in order of their times of change, then names; an offset is the last file taken."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("partitionBytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((t, p) for p, _, t in listed(self.path, self.pattern)), default=(0, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.path, self.pattern) if a < (f[2], f[0]) <= b], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from sections_of(partition.paths)


class SectionsSource(DataSource):
    """Rows (path, section_id, title, locator, markdown, error) of all files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SectionsReader:
        return SectionsReader(self.options)

    def streamReader(self, schema: StructType) -> SectionsStream:
        return SectionsStream(self.options)


def register(spark: SparkSession) -> None:
    from .one_file import OneFileSink

    spark.dataSource.register(SectionsSource)
    spark.dataSource.register(OneFileSink)


