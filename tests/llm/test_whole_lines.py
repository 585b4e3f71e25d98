"""Line dedup of the registered query and of the pipeline: lines of any number of words take part."""

import corpus_pipeline
import numpy as np

from tessera.llm import queries
from tessera.llm.lines import Window, dedup_lines, removed_lines
from tessera.llm.scratch import read
from tests.llm.test_operators import brute_removed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "All rights reserved.\nHome | About\nmenu\none two three four\n\n"), (2, "ALL rights reserved.\nmenu\n\none two three four five"), (3, "menu\nAll rights\nAbout | Home"), (4, "\n\n"), (5, "menu")]
LEFT = {1: ROWS[0][1], 2: "", 3: "All rights", 4: "\n\n", 5: ""}


def without(text, doc_id, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)


def test_query_by_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    gone = brute_removed(list(rows.items()), 1)
    assert len(gone) > len(brute_removed(list(rows.items())))
    assert {r.doc_id: r.text for r in queries.op5_line_dedup(spark, sf_dir).collect()} == {d: without(t, d, gone) for d, t in rows.items()}


def test_short_lines(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in ROWS], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute_removed([r[:2] for r in ROWS], 1)
    assert {d: without(t, d, gone) for d, t in ROWS} == LEFT
    assert {r.doc_id: r.text for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()} == LEFT
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    assert {r.doc_id: r.text for r in stage(spark, docs, str(tmp_path)).collect()} == {d: t for d, t in LEFT.items() if t.split() or d == 4}


def test_long_text_that_loses_most_lines(spark):
    """One text of 20,000 lines, of which all but a few stand in earlier documents too, and one line that stands in every document."""
    common = "this very line stands in all of the documents"
    own = [f"{' '.join(f'{c}{i}' for c in 'abcdefg')}" for i in range(20000)]
    rows = [(d, "\n".join([common, *own[d * 200 : d * 200 + 200]])) for d in range(99)] + [(99, "\n".join([*own, common]))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].text == "\n".join(own[19800:]) and got[99].n_removed == 19801 and got[0].n_removed == 0
    assert all(got[d].n_removed == 1 for d in range(1, 99))


def test_salted_words_windows_and_passes(spark, sf_dir):
    """Words dealt into salts, windows of few lines, several passes over the hot words and a filter that is too small change nothing."""
    table = read(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id % 4 = 0")
    hot = [(-1 - d, "\n".join(["the same line in all of these documents", f"the same line in all of those documents {d % 7}", "the"])) for d in range(300)]
    docs = table.unionByName(spark.createDataFrame(hot, table.schema)).repartition(5)
    want = brute_removed([(r.doc_id, r.text) for r in docs.collect()], 1)
    assert len(want) > 600
    for options in ({}, {"hot_rows": 2, "hot_words": 3, "window_lines": 4, "buckets": 7}, {"hot_rows": 2, "window_lines": 1}, {"hot_rows": 5, "hot_words": 40, "often_words": 50, "bloom_mb": 0}):
        assert {(r.doc_id, r.line) for r in removed_lines(docs, **options).collect()} == want, options


def test_window():
    window = Window()
    names, one = np.array([3, 7, 9], np.uint64), np.array([5, 5, 5])
    at, known = window.find(names)
    assert not known.any()
    window.add(at, names, one, one)
    at, known = window.find(np.array([1, 3, 9, 11], np.uint64))
    assert known.tolist() == [False, True, True, False]
    earlier, beaten = window.meet(at[known], np.array([4, 5]), np.array([8, 6]))
    assert earlier.tolist() == [True, False] and beaten.tolist() == [[5, 5], [5, 6]]
    earlier, beaten = window.meet(at[known], np.array([4, 5]), np.array([8, 5]))  # the same places do nothing
    assert not earlier.any() and beaten.shape == (2, 0)
    assert window.doc.tolist() == [4, 5, 5] and window.number.tolist() == [8, 5, 5]
