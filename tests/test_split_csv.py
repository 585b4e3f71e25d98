"""CSV files with line breaks in cells, cut anywhere, against the reader of whole files."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.sections import read_csv
from tessera.sources.split_csv import read_cells, read_split_table, sniff_separator, split_csv_sections
from tessera.sources.tables import typed

FILES = {
    "breaks.csv": 'id,"na""me",note\r\n1,"two\nlines","a, b"\r\n\r\n2,"say ""so""\r\nand\n\nmore",x|y\r\n , ,\n3,short\n4,a,b,too,long\n5,"é\n""",end',
    "quotes.csv": 'a;b\n"1;2";"""\n"""\n"";"\n"\n"x";"y"\n',
    "head.csv": "only,a,header\n\n",
    "many.csv": "n,t\n" + "".join(f'{i},"row\n{i}"\n' for i in range(230)),
}


@pytest.fixture
def cut(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "sizes"), [("breaks.csv", (1, 2, 7, 50, 10000)), ("quotes.csv", (1, 3, 10000)), ("head.csv", (1, 10000)), ("many.csv", (61, 10000))])
def test_cut_files_equal_whole_ones(spark, tmp_path, cut, name, sizes):
    path = tmp_path / name
    path.write_bytes(FILES[name].encode())
    want = [(k, *s) for k, s in enumerate(read_csv(path.read_bytes()), 1)]
    for size in sizes:
        cut(size)
        got = split_csv_sections(spark, str(path), sniff_separator(spark, str(path)))
        assert [tuple(r)[1:] for r in got.orderBy("section_id").collect()] == want


def test_several_files_and_a_typed_table(spark, tmp_path, cut):
    for name in ("breaks.csv", "many.csv"):
        (tmp_path / name).write_bytes(FILES[name].encode())
    (tmp_path / "blank.csv").write_text("\n ,\n")
    cut(20)
    found = read_cells(spark, str(tmp_path), ",")
    assert {r.path.rsplit("/", 1)[1]: r.n for r in found.groupBy("path").agg(F.max("number").alias("n")).collect()} == {"breaks.csv": 5, "many.csv": 230}
    table = typed(read_split_table(spark, str(tmp_path / "many.csv")))
    assert dict(table.dtypes) == {"n": "double", "t": "string"} and table.agg(F.sum("n")).first()[0] == 229 * 115 and table.where("n = 7").first().t == "row\n7"
    with pytest.raises(ValueError, match="no rows"):
        read_split_table(spark, str(tmp_path / "blank.csv"), ",")
