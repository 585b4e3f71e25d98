"""Findings of round 3: each test failed before its change."""

import re

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions.model_json import json_problems
from tessera.operators import markdown, privacy, retrieval
from tessera.operators.inverted import PassageIndex


def test_page_titles_as_written(spark, tmp_path):
    """References other than &amp; stay, as the SQL has it: cut ones at a title's end too."""
    titles = ["a &amp;&amp; b&amp", "x = &quot;0b9", "&amp;lt; &lt;", " both ends\t", "", "a\nb"]
    pages = [(k, f"http://x/{k}", f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(titles)] + [(90, "u", None), (91, "u", "<p>no title</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(catalogue.ORACLE_SQL["page_titles"].replace("from pages", f"from read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["page_titles"](spark, str(tmp_path)).collect())) == sorted(want)


def test_scores_stay_where_passages_lie(spark, tmp_path):
    """No shuffle of a search moves rows by question and passage: only parts of passages and each part's best move."""
    rows = [(d, 0, [f"w{d % 7}", f"w{d % 5}", "common"]) for d in range(200)]
    chunks = spark.createDataFrame(rows, "doc_id long, order int, tokens array<string>")
    asked = spark.createDataFrame([(q, ["common", f"w{q}"]) for q in range(5)], "query_id int, terms array<string>")
    index = PassageIndex(spark, str(tmp_path / "index"))
    index.append(chunks)
    found = retrieval.bm25(asked, chunks, 3)
    searched = index.search(asked, 3, str(tmp_path / "search"))
    for df in (found, searched):
        plan = df._jdf.queryExecution().toString()
        assert not re.search(r"hashpartitioning\([^)]*query_id[^)]*doc_id", plan) and "WindowGroupLimit" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, searched.collect()))


def test_counts_of_terms_in_a_row(spark):
    rows = [(1, 0, ["b", "a", "b", "é", "b"]), (2, 0, []), (3, 0, None), (4, 0, ["x"])]
    got = retrieval.term_counts(spark.createDataFrame(rows, "doc_id long, order int, tokens array<string>")).collect()
    assert {r.doc_id: (r.length, [tuple(t) for t in r.terms]) for r in got} == {1: (5, [("a", 1), ("b", 3), ("é", 1)]), 2: (1, []), 3: (1, []), 4: (1, [("x", 1)])}


def test_model_json_is_parsed_once(spark):
    schema = {"a": "string", "b": [{"c": "integer"}], "d?": "any"}
    assert json_problems(F.col("t"), schema)._jc.toString().count("parse_json") == 1
    rows = spark.createDataFrame([('{"a":1,"b":[{"c":1},{"c":"x","e":2}]}',), ("[",), (None,), ("3",), ('{"b":null,"d":{}}',)], "t string")
    assert [r.p for r in rows.select(json_problems(F.col("t"), schema).alias("p")).collect()] == [
        ["$.a: no string", "$.b[1].e: extra", "$.b[1].c: no integer"], ["$: no JSON"], ["$: no JSON"], ["$: no object"], ["$.a: missing", "$.b: no list"],
    ]


def test_markdown_parts_follow_the_texts(spark, monkeypatch):
    """Windows over lines run in parts by the texts' size, not by how many bytes a shuffle has packed."""
    monkeypatch.setattr(markdown, "PART", 1000)
    docs = spark.createDataFrame([(d, "# Title\n\n- one\n- two") for d in range(100)], "doc_id long, text string")
    found = markdown.blocks(docs)
    assert "hashpartitioning(doc_id" in (plan := found._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan
    assert found.count() == 200


def test_scan_holds_few_texts_at_a_time():
    """A batch of Arrow's is answered in slices; keys stay with their findings."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"a{k}@b.fi" if k % 3 else None for k in range(1000)]})
    out = list(privacy._findings(iter([batch])))
    assert max(b.num_rows for b in out) <= privacy.TEXTS
    assert {k: [f["text"] for f in found] for b in out for k, found in zip(*(c.to_pylist() for c in b.columns))} == {k: [f"a{k}@b.fi"] if k % 3 else [] for k in range(1000)}
