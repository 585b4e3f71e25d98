"""The classifiers word by word and position by position, and the pipeline's stages against slow versions of their rules."""

import math
import tracemalloc
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import learn, lines, quality, tokens, toxicity
from tessera.llm.scratch import read, save
from tessera.llm.tokens import Words
from tests.llm.test_operators import SPACE, brute_fingerprint, components


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("doc_id < 120")
    odd = spark.createDataFrame([(1000, None, "en", None, None), (1001, "", "en", "a", 0), (1002, "word", None, "a", 1), (1003, "two words", "fi", "b", 2)], docs.schema)
    return docs.unionByName(odd).cache(), read(spark, sf_dir, "labels")


def said(text):
    return [w for w in SPACE.split(text or "") if w]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_toxicity_filter_by_filter(spark, tables):
    docs, labels = tables
    net, cells = toxicity.fit(docs, labels), {}
    for r in docs.collect():
        for w in said(r.text):
            cells.setdefault(w, toxicity.features(Words(pa.array([w])))[0])
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.collect():
        vectors = [net.embed[cells[w]].astype(float).sum(0) for w in said(r.text)]
        pooled = np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS)
        for k, width in enumerate(toxicity.WIDTHS if vectors else ()):
            for f in range(toxicity.FILTERS):
                best = -math.inf
                for at in range(len(vectors)):
                    parts = [vectors[at + j] @ net.filters[:, toxicity.COLUMNS.index((width, j)) * toxicity.FILTERS + f].astype(float) for j in range(width) if at + j < len(vectors)]
                    best = max(best, sum(parts))
                pooled[k * toxicity.FILTERS + f] = max(best + net.bias[k * toxicity.FILTERS + f], 0)
        assert got[r.doc_id] == pytest.approx(sigmoid((pooled @ net.out + net.offset) / net.heat + net.prior), abs=1e-4)


def test_quality_word_by_word(spark, tables):
    """Word vectors from neighbours and shapes one word at a time, pooled and put through the two layers."""
    docs, labels = tables
    vectors, net = quality.fit(docs, labels)
    hashes, table, rows = {}, defaultdict(lambda: np.zeros(quality.DIM)), docs.collect()
    word = lambda w: hashes.setdefault(w, int(Words(pa.array([w]), lower=False).hashes()[0]))
    index = {}

    def entry(key):
        if key not in index:
            place, sign = quality.index_vectors(np.array([key], np.uint64), 42)
            index[key] = np.bincount(place[:, 0], sign[:, 0], minlength=quality.DIM)
        return index[key]

    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for r in rows:
        ws = said(r.text)
        for i, w in enumerate(ws):
            upper, lower = (sum(a <= c <= b for c in w) for a, b in (("A", "Z"), ("a", "z")))
            case = 3 if not upper and not lower else 2 if upper and not lower else 1 if upper else 0
            shape = ((case * 3 + min(2, sum(c in marks for c in w))) * 2 + (i > 0 and ws[i - 1] == w)) * 2 + any(c in "0123456789" for c in w)
            own = table[word(w) % quality.ENTRIES]
            own += entry((1 << 64) - 1 - shape)
            for j in (i - 1, i + 1):
                if 0 <= j < len(ws):
                    own += entry(word(ws[j]))
    for k, v in table.items():
        assert vectors[k] == pytest.approx(v / max(np.linalg.norm(v), 1e-12), abs=1e-5)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for r in rows:
        ws = said(r.text)
        x = np.zeros(quality.DIM + 1)
        for w in ws:
            x[: quality.DIM] += vectors[word(w) % quality.ENTRIES].astype(float) / len(ws)
        x[quality.DIM] = math.log1p(len(ws)) / 10
        hidden = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, h] for i in range(len(x))) + net.b1[h]) for h in range(len(net.b1))]
        assert got[r.doc_id] == pytest.approx(sigmoid((sum(a * b for a, b in zip(hidden, net.w2, strict=True)) + net.b2[0]) / net.heat), abs=1e-6)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    before, out = read(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = save(stage(spark, before, sf_dir), name)
        out[name], before = (before, after), after
    return out


def test_quality_stage_keeps_by_held_out_labels(spark, sf_dir, stages):
    inside, outside = stages["quality"]
    labels = {r.doc_id: r.quality for r in read(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in outside.collect()}
    good = [d in kept for d in (r.doc_id for r in inside.collect()) if labels.get(d) == 1]
    bad = [d in kept for d in (r.doc_id for r in inside.collect()) if labels.get(d) == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5


def test_near_duplicates_stage_by_pairs(stages):
    inside, outside = stages["near_duplicates"]
    rows = sorted((r.doc_id, brute_fingerprint(r.text)) for r in inside.collect())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3]
    root = components(len(rows), links)
    assert sorted(r.doc_id for r in outside.collect()) == [d for i, (d, _) in enumerate(rows) if root[i] == i]


def test_mixing_stage_meets_targets(stages):
    inside, outside = stages["mixing"]
    sizes = {r.doc_id: len(said(r.text)) for r in inside.collect()}
    source = {r.doc_id: r.source for r in inside.collect()}
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(sizes[d] for d in sizes if source[d] == s) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        target |= {s: 2 * total[s] for s in over} or share
        left -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    copies = Counter(r.doc_id for r in outside.collect())
    for s in names:
        taken = sum(n * sizes[d] for d, n in copies.items() if source[d] == s)
        assert abs(taken - target[s]) <= max(0.02 * target[s], max(sizes[d] for d in sizes if source[d] == s))
    assert max(copies.values()) <= 2


def test_packing_stage_by_tokens(stages):
    inside, outside = stages["packing"]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    wanted = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in inside.collect())
    rows = outside.collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length) for r in rows)
    assert pieces == Counter((d, k, k * 2048, min(2048, n - k * 2048)) for (d, n), times in wanted.items() for _ in range(times) for k in range(-(-n // 2048)))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(bins) <= 1 + 1.02 * sum(r.length for r in rows) / 2048


def test_quality_gathers_vectors_in_blocks(monkeypatch):
    """Pooling holds the vectors of a block of words, not of a slice or a long text, and blocks don't change the means."""
    vectors = np.random.default_rng(3).standard_normal((quality.ENTRIES, quality.DIM)).astype(np.float32)
    long = pa.array(["a b c " * 60_000, None, "x y"])
    quality.pooled(long, vectors)  # tables of powers stay
    tracemalloc.start()
    whole = quality.pooled(long, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    monkeypatch.setattr(quality, "BLOCK", 7)
    texts = pa.array(["", "a b c d e f g", "a b c d e f g h i", None, "one", "x " * 15, "q r"])
    got = quality.pooled(texts, vectors)
    assert quality.pooled(long, vectors)[2] == pytest.approx(whole[2])
    for row, text in zip(got, texts.to_pylist(), strict=True):
        ws = said(text)
        own = [vectors[int(Words(pa.array([w]), lower=False).hashes()[0]) % quality.ENTRIES] for w in ws]
        assert row[: quality.DIM] == pytest.approx(np.mean(own, axis=0, dtype=np.float64) if ws else np.zeros(quality.DIM))


def test_tables_leave_tasks_in_small_batches(spark):
    """sum_tables adds up all parts' slices, more of them than a batch takes."""
    n = 3 * learn.SENT + 1

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([k] * n, pa.int32()), pa.array([np.array([s, k], np.int32).tobytes() for s in range(n)])], ["slice", "salt", "cells"])

    sums = dict(learn.sum_tables(spark.range(40).mapInArrow(run, "slice int, salt int, cells binary"), np.int32))
    assert {s: x.tolist() for s, x in sums.items()} == {s: [40 * s, 780] for s in range(n)}


def test_stages_bound_batches_by_bytes(spark, sf_dir):
    """A stage's tasks get batches of few bytes, however long the texts are."""
    docs = spark.createDataFrame([(k, "word " * 400_000, "en", "a", 2_000_000) for k in range(24)], read(spark, sf_dir, "documents").schema).coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.packing(spark, docs, sf_dir)
    size = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert size <= corpus_pipeline.BATCH_BYTES + (4 << 20)


def test_hashing_keeps_no_memory_of_long_texts():
    """What a long text's hashes needed isn't kept after it; a word has one hash at any place of it."""
    text = b"word " * 1_600_000
    start = np.arange(0, len(text), 5)
    data = np.frombuffer(text, np.uint8)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        found = np.unique(tokens.span_hashes(data, start, start + 4))
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert found.tolist() == Words(pa.array(["word"])).hashes().tolist()
    assert kept < 1 << 20


def test_words_are_counted_in_a_table_of_fixed_size(spark):
    """Counts add up over tables that fill, and over a text with more words than a table takes."""
    texts = ["a b c a", "b c d", "a " * 30, "", "e f g h i j k a", "a b c d e f"]
    rows = lines.count_words(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), 40, most=8).collect()
    got = {}
    for r in rows:
        names, counts = np.frombuffer(r.blob, np.int64).reshape(2, -1)
        got |= dict(zip(names.view(np.uint64).tolist(), counts.tolist(), strict=True))
    want = Counter(w for t in texts for w in t.split())
    assert got == {int(tokens.mix(Words(pa.array([w])).hashes())[0]): n for w, n in want.items()}
