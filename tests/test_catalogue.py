"""Every registered query of the library against its SQL in DuckDB; those without SQL must run."""

import glob
import math
import os

import duckdb
import pytest

from tessera import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else None if x is None else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name in catalogue.ORACLE_SQL:
        cursor = duck.execute(catalogue.ORACLE_SQL[name])
        data = cursor.fetchall()
        assert got == rows([c[0] for c in cursor.description], data)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())
