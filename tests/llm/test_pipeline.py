"""The pipeline's stages against what they promise, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm.quality import quality_scores
from tessera.llm.scratch import read, save
from tessera.llm.simhash import simhash_components
from tests.llm.test_operators import brute_removed


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, before, got = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = save(stage(spark, before, sf_dir), name)
        got[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        before = after
    inside, outside = got["quality"]
    kept = quality_scores(inside, read(spark, sf_dir, "labels")).where("predicted = 1")
    assert {r.doc_id for r in outside.collect()} == {r.doc_id for r in kept.collect()}
    inside, outside = got["line_dedup"]
    rows = {r.doc_id: r.text for r in inside.collect()}
    gone = brute_removed(list(rows.items()), 1)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows.items()}
    want = {d: t for d, t in want.items() if t.split() or not any(g[0] == d for g in gone)}
    assert {r.doc_id: r.text for r in outside.collect()} == want and all(r.n_chars == len(r.text) for r in outside.collect() if any(g[0] == r.doc_id for g in gone))
    inside, outside = got["near_duplicates"]
    heads = simhash_components(inside).where(F.col("doc_id") == F.col("component_id"))
    assert {r.doc_id for r in outside.collect()} == {r.doc_id for r in heads.collect()}
    inside, outside = got["mixing"]
    assert max(r["count"] for r in outside.groupBy("doc_id").count().collect()) <= 2 and outside.select("doc_id").exceptAll(inside.union(inside).select("doc_id")).count() == 0
    inside, outside = got["packing"]
    assert outside.where("piece = 0").count() == inside.count()


def test_empty_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
