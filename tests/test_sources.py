"""The data source of sections, and the sink of one file."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from tessera.sources import one_file, source
from tessera.sources.sections import read_sections


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts, tables, a folder below, a broken workbook, an unknown ending and an empty file."""
    source.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    root = tmp_path_factory.mktemp("files")
    (root / "below").mkdir()
    for i in range(7):
        (root / f"t{i}.md").write_text(f"# Title {i}\n\nSome text of file {i}.")
    (root / "below" / "t.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(250)))
    (root / "broken.xlsx").write_bytes(b"no workbook")
    (root / "odd.xyz").write_text("?")
    (root / "empty.txt").write_text("")
    (root / "_hidden.md").write_text("not here")
    return root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_source_equals_reader(spark, folder):
    want = [r for r in rows(read_sections(spark, str(folder))) if "_hidden" not in r[0]]
    for size in ("1", "40", "1000000"):
        df = spark.read.format("sections").option("partitionBytes", size).load(str(folder))
        empty = (f"file:{folder}/empty.txt", 0, None, None, None, "The file holds no text.")  # Spark's own file sources pass empty files over
        assert rows(df) == sorted([*want, empty], key=str) and len({r[0] for r in want if r[5]}) == 2
    assert df.rdd.getNumPartitions() == 1 and spark.read.format("sections").option("partitionBytes", "1").load(str(folder)).rdd.getNumPartitions() == 10  # the empty file goes with its neighbour


def test_source_pushes_paths(spark, folder, capsys):
    df = spark.read.format("sections").load(str(folder)).where(F.col("path").endswith(".md") & F.col("path").startswith(f"file:{folder}/t") & (F.col("section_id") == 1))
    assert {r.path[-5:] for r in df.collect()} == {f"t{i}.md" for i in range(7)}
    reader = source.SectionsReader({"path": str(folder), "partitionBytes": "1"})
    left = list(reader.pushFilters([source.StringEndsWith(("path",), ".csv"), source.EqualTo(("section_id",), 1), source.In(("path",), (f"file:{folder}/below/t.csv",))]))
    assert [p.paths for p in reader.partitions()] == [(f"file:{folder}/below/t.csv",)] and [type(f) for f in left] == [source.EqualTo]
    assert rows(spark.read.format("sections").load(str(folder)).where(F.col("path") == f"file:{folder}/t3.md")) == [(f"file:{folder}/t3.md", 1, *rows(read_sections(spark, str(folder / "t3.md")))[0][2:])]
    assert spark.read.format("sections").option("pattern", "*.none").load(str(folder)).count() == 0
    assert spark.read.format("sections").load(str(folder / "nowhere")).count() == 0


def test_source_as_stream(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("first")

    def run():
        stream = spark.readStream.format("sections").load(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["first"]
    (tmp_path / "in" / "b.md").write_text("second")
    assert run() == ["first", "second"] and run() == ["first", "second"]  # goes on after the last file


def test_one_csv_file(spark, folder, tmp_path):
    cells = [("plain", 1, None), ("=1+1", 2, "a,b"), ('say "so"', -3, "two\nlines"), ("", None, "é"), ("+x", 5, "-5")]
    df = spark.createDataFrame(cells, 'name string, `n, "n"` int, note string').repartition(3).orderBy(F.col("name"))
    path = tmp_path / "list.csv"
    path.write_text("what was there")
    one_file.write_csv_file(df, str(path))
    data = path.read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and sorted(p.name for p in tmp_path.iterdir()) == ["list.csv"]
    safe = lambda c: "" if c is None else f"'{c}" if str(c) in ("=1+1", "+x") else str(c)
    out = io.StringIO()
    csv.writer(out).writerows([("name", 'n, "n"', "note"), *([safe(c) for c in row] for row in sorted(cells))])
    assert data[3:].decode() == out.getvalue()


def test_aborted_file_leaves_nothing(spark, folder, tmp_path):
    path = tmp_path / "list.txt"
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="no"):
        one_file.write_text_file(bad, str(path))
    assert list(tmp_path.iterdir()) == []
    path.write_text("kept")
    with pytest.raises(Exception, match="no"):
        one_file.write_text_file(bad, str(path))
    assert path.read_text() == "kept" and len(list(tmp_path.iterdir())) == 1
    one_file.write_text_file(spark.createDataFrame([("# A\n\nb",), (None,)], "text string").coalesce(1), str(path))
    assert path.read_text() == "# A\n\nb\n\n"
    one_file.write_text_file(spark.createDataFrame([], "text string"), str(path))
    assert path.read_text() == ""
