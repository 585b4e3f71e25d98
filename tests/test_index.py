"""The written index against the ranking over passages, and the band join against a comparison of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import grounding, inverted, retrieval
from tessera.operators.inverted import PassageIndex


def ranked(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.order, round(r.score, 4)) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    """Passages of a few very common words and many rare ones, some empty, some repeated."""
    rng = random.Random(4)
    common, rare = [f"common{i}" for i in range(6)], [f"rare{i}" for i in range(3000)]
    rows = [(d, o, rng.choices(common, k=rng.randrange(0, 60)) + rng.choices(rare, k=rng.randrange(0, 12))) for d in range(700) for o in range(3)]
    rows += [(900, 0, []), (901, 0, ["common1"] * 50), (901, 0, ["common1"] * 50), (902, 0, ["rare7", "rare7", "rare8"])]
    return spark.createDataFrame(rows, "doc_id long, order int, tokens array<string>").repartition(5).cache()


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(9)
    rows = [(q, [f"common{rng.randrange(6)}"] + [f"rare{rng.randrange(3000)}" for _ in range(rng.randrange(4))]) for q in range(40)]
    return spark.createDataFrame([*rows, (90, []), (91, ["nowhere"]), (92, ["rare7", "rare7", "common0"]), (93, None)], "query_id int, terms array<string>")


@pytest.mark.parametrize("parts", [["true"], ["doc_id < 300", "doc_id >= 300 and order = 0", "doc_id >= 300 and order > 0", "false"]])
def test_index_equals_ranking(spark, chunks, questions, tmp_path, parts):
    index = PassageIndex(spark, str(tmp_path / "index"), folders=2)
    assert index.segments() is None
    for part in parts:
        index.append(chunks.where(part))
    once = chunks.dropDuplicates(["doc_id", "order"])
    assert index.totals()[0] == chunks.count()
    for k in (1, 8):
        got = index.search(questions, k, str(tmp_path / f"search{k}"))
        if len(parts) > 1:  # passages that come twice are one row of a term's counts in the same segment
            assert [r[:2] for r in ranked(got)] == [r[:2] for r in ranked(retrieval.bm25(questions, chunks, k))]
    index = PassageIndex(spark, str(tmp_path / "once"), folders=2)
    for part in parts:
        index.append(once.where(part))
    assert ranked(index.search(questions, 8, str(tmp_path / "search"))) == ranked(retrieval.bm25(questions, once, 8))
    df = {r.term: r.df for r in index.term_statistics().collect()}
    assert df == {r.term: r.n for r in once.select("doc_id", "order", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_index_skips_slots(spark, tmp_path):
    """One passage holds the rare word: slots without it can't reach its score, though all hold the common one."""
    rows = [(d, 0, ["common"] * (1 + d % 3) + [f"own{d}"]) for d in range(4000)] + [(9999, 0, ["needle", "needle", "common"])]
    index = PassageIndex(spark, str(tmp_path / "index"), folders=2)
    index.append(spark.createDataFrame(rows, "doc_id long, order int, tokens array<string>"))
    asked = spark.createDataFrame([(1, ["needle", "common"])], "query_id int, terms array<string>")
    assert [(r.doc_id, r.rank) for r in index.search(asked, 1, str(tmp_path / "s")).collect()] == [(9999, 1)]
    assert index.share_read(str(tmp_path / "s")) < 0.5


def test_segments_without_counts_are_not_there(spark, chunks, questions, tmp_path):
    """A segment whose counts were never written, as after a failure, is not read, and its number is free again."""
    index = PassageIndex(spark, str(tmp_path / "index"), folders=2)
    index.append(chunks.where("doc_id < 100"))
    before = ranked(index.search(questions, 3, str(tmp_path / "a")))
    index.append(chunks.where("doc_id >= 100"))
    for f in (tmp_path / "index" / "counts" / "segment=1").iterdir():
        f.unlink()
    assert ranked(index.search(questions, 3, str(tmp_path / "b"))) == before


def test_language_and_titles(spark):
    rows = [(1, 0, "the cat and the", "T"), (1, 1, "dog was here", None), (2, 0, "kissa on ja ei ole", ""), (2, 1, "koira ovat taloissamme", "Otsikko"), (3, 0, "x", None), (4, 0, "a " * 9999, None), (4, 1, "the and of was that", None)]
    df = spark.createDataFrame(rows, "doc_id long, order int, text string, title string")
    assert {r.doc_id: r.language for r in inverted.document_language(df).collect()} == {1: "en", 2: "fi", 3: None, 4: None}
    tokens = {(r.doc_id, r.order): r.tokens for r in inverted.searchable(df, F.col("title")).collect()}
    assert tokens[2, 1] == ["otsikko", "koira", "taloissamme", "~talois"] and tokens[1, 0] == ["cat"]


def close(a, b):
    return abs(a - b) < 1e-6 * max(1, abs(a), abs(b))


def test_close_numbers_share_bands(spark):
    rng = random.Random(2)
    pairs = [(v, v + s * f * 1e-6 * max(1, abs(v))) for v in [0.0, 0.5, 1.0, -1.0, 1.0000004, 12.5, -9e5, 3e17, 1e300] + [math.exp(rng.uniform(-5, 300)) for _ in range(300)] for s in (1, -1) for f in (0.0, 0.3, 0.999, 0.9999999)]
    rows = spark.createDataFrame(pairs, "a double, b double").select("a", "b", F.array_contains(N.bands(F.col("a")), N.band(F.col("b"))).alias("met")).collect()
    assert all(r.met for r in rows if close(r.a, r.b))
    assert sum(close(r.a, r.b) for r in rows) > 1000


def test_unsupported_rows(spark):
    """Sources by document, a question's own numbers, both readings of a token, numbers listed twice, and no numbers at all."""
    answers = [(1, "In 1999 it was 1,500 or 44.4 and 77 and 77 and 12.", "What of 77?", [10, 10, 11]), (2, "It was 1.5 and 31 and 5000001.", None, [11]), (3, None, "?", [10]), (4, "It was 99.", "?", []), (5, "It was 99.", "?", None)]
    sections = [(10, "Total 1500 in 1999."), (10, None), (11, "About 1,5 and 5000000."), (12, "99")]
    a = spark.createDataFrame(answers, "answer_id int, answer string, question string, doc_ids array<long>")
    got = grounding.unsupported(a, spark.createDataFrame(sections, "doc_id long, markdown string")).collect()
    assert sorted((r.answer_id, r.token) for r in got) == [(1, "44.4"), (2, "31"), (4, "99"), (5, "99")]
