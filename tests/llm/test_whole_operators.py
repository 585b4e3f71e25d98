"""Planted pairs, cut groups, several shards, blocks and rounds, clashing names and contradicting labels: one small parameter each."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.lines import dedup_lines
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.pstable import near_vectors
from tessera.llm.quality import quality_scores
from tessera.llm.scratch import read, unused
from tessera.llm.simhash import gray_pairs, simhash_components
from tessera.llm.toxicity import toxicity_scores
from tessera.llm.vptree import nearest
from tests.llm.test_operators import brute_removed, components

#: Names that the operators use for columns of their own.
TAKEN = ("base", "cut0", "cut1", "__name", "__null", "__text", "whole_text", "gone", "touched", "gone_id", "__gone", "rid", "levels", "name", "more", "cell", "u", "class", "rate", "shard", "codes", "chunk", "block", "cells", "label", "x", "h", "rep")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four five\nAll rights reserved.", "en", "a", 5), (2, "one two three four five\nall rights reserved.\nmore words here", "en", "b", 5), (3, None, None, None, None), (3, "", "fi", "b", 0), (None, "no id", "en", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in TAKEN})


def test_clashing_names(spark, clashing, sf_dir):
    labels, n = read(spark, sf_dir, "labels"), clashing.count()
    for f in (lambda x: quality_scores(x, labels), lambda x: toxicity_scores(x, labels), mixed, dedup_lines, simhash_components, pack):
        out = f(clashing)
        assert out.count() == n
        assert all(r[c] == "clash" for r in out.collect() for c in TAKEN if f in (mixed, dedup_lines) and c in out.columns and c != "rate")
    for name, stage in corpus_pipeline.STAGES:
        if name != "packing":
            out = stage(spark, clashing, sf_dir)
            assert out.columns == clashing.columns and out.count() <= 2 * n
    assert dict(corpus_pipeline.STAGES)["line_dedup"](spark, clashing.drop("n_chars"), sf_dir).count() <= n
    assert unused(["A", "a_"], "a", "b", "b") == ["a__", "b", "b_"]


def test_contradicting_labels_and_repeated_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").limit(150).cache()
    labels = read(spark, sf_dir, "labels")
    twice = labels.union(labels.withColumn("quality", F.lit(0)).withColumn("toxic", F.lit(0)))
    key = lambda rows: {r.doc_id: round(r.score, 12) for r in rows}
    assert key(quality_scores(docs, twice).collect()) == key(quality_scores(docs, labels.orderBy(F.desc("doc_id"))).collect())
    assert key(toxicity_scores(docs, twice).collect()) == key(toxicity_scores(docs, labels.repartition(3)).collect())


def planted(n, pairs, seed=5, dim=48):
    """Unit vectors of which some are turned by angles about that of cosine 0.95, in chains of three."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(pairs):
        for step in (1, 2):
            v = x[3 * k + step - 1] / np.linalg.norm(x[3 * k + step - 1])
            w = rng.standard_normal(dim)
            w -= (w @ v) * v
            cosine = rng.uniform(0.93, 0.999)
            x[3 * k + step] = (cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)) * rng.uniform(0.5, 2)
    return x.astype(np.float32)


@pytest.mark.parametrize("group_rows", [1024, 8])
def test_planted_near_vectors(spark, group_rows):
    x = planted(1500, 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[0].tolist())], "vec_id long, embedding array<float>")
    v = np.vstack([x, x[:1]]).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = np.argwhere(np.triu(v @ v.T >= 0.95, 1))
    want = Counter(links.ravel().tolist())
    root = components(len(v), links.tolist())
    got = {(len(x) if r.vec_id == 5000 else r.vec_id): r for r in near_vectors(df, group_rows=group_rows).collect()}
    assert all(r.n_links <= want[i] for i, r in got.items()) and sum(r.n_links for r in got.values()) >= 0.96 * sum(want.values())
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.95


def test_near_vectors_of_clashing_lengths(spark):
    """Lengths that share a bucket's number, and so a cell, link as each would alone, in whole and in cut buckets."""
    rng = np.random.default_rng(2)
    short = [np.array([np.cos(t), np.sin(t)]) for t in rng.uniform(0, 6.28, 60)]
    long = [np.concatenate([rng.standard_normal(3) * 0.05 + 1, np.zeros(2 + 2048 - 3)]) for _ in range(24)]
    row = lambda k, x: (k, [float(v) for v in x])
    a, b = [row(i, x) for i, x in enumerate(short)], [row(100 + i, x) for i, x in enumerate(long)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = lambda rows, most: {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame(rows), group_rows=most).collect()}
    for most in (1024, 16):
        assert links(a + b, most) == links(a, most) | links(b, most)


def test_too_many_tables_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.pstable.MOST_TABLES", 2)
    with pytest.raises(ValueError, match="tables"):
        near_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>"))


def test_nearest_in_several_shards_and_blocks(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").where("vec_id < 400").cache()
    asked = df.where("vec_id % 20 = 0")
    key = lambda rows: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)
    assert key(nearest(df, asked, factor=1.0).collect()) == key(nearest(df, asked, factor=1.0, shard_rows=50, block_rows=4).collect())
    tied = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(9)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(nearest(tied, tied.where("vec_id = 9"), k=3, factor=1.0, shard_rows=3).collect(), key=lambda r: r.rank)] == [(1, 0), (2, 2), (3, 4)]


def test_lines_of_hot_words(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(9)]
    rows = [(d, "\n".join(" ".join(rng.choice(pool, rng.integers(1, 8))) for _ in range(6))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_removed(rows, 1)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    for hot_rows in (3, 8192):
        assert {r.doc_id: r.text for r in dedup_lines(df, min_words=1, hot_rows=hot_rows).collect()} == want


def test_near_fingerprints_in_cut_blocks():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for k in range(0, 390, 3):
        for step in (1, 2):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            fp[k + step] = fp[k + step - 1] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
    found = {(int(i), int(j)) for a, b in gray_pairs(fp, np.zeros(len(fp), int), 3, 64) for i, j in zip(a, b)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}


def test_packing_in_several_shards(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack(docs, shard_rows=40).collect()
    whole = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in pack(docs).collect()}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == whole
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [p[0] for p in parts] == np.concatenate([[0], np.cumsum([p[1] for p in parts])[:-1]]).tolist() and sum(p[1] for p in parts) <= 2048


def test_mixing_reaches_targets_on_rows_with_ids_repeated(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    both = docs.union(docs.where("doc_id % 7 = 0"))
    rows = mixed(both).collect()
    copies = defaultdict(set)
    for r in rows:
        copies[r.doc_id].add(r.copies)
    assert len(rows) == both.count() and all(len(c) == 1 for c in copies.values())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_with_other_vocabularies(spark, name):
    path = public_tokenizers.path(name)
    encode = Tokenizer.from_file(path)
    texts = ["Two  words, it's 1234 Ärger.", None, "", "<|endoftext|> inside", "é " * 900]
    out = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path, capacity=512).collect()
    for d, text in enumerate(texts):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted((r.piece, r.length, r.ids_crc32) for r in out if r.doc_id == d)
        assert got == [(k, min(512, len(ids) - s), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
