"""N-grams seen once in training count as seen; scores come from the filter, in one round or in many."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm.lm import AFTER, AFTER_1, AFTER_2, BI, COUNTS, FILTER, TRI, VALUE, Model, after, bucket_edges, context_parts, count_ngrams, filter_room, keys, score_texts, sequence, shared_filter, word_totals
from tessera.llm.scratch import read
from tessera.llm.tokens import Words
from tests.llm.test_operators import words


def test_single_ngrams_enter_the_filter(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 300)) for _ in range(20)]
    buckets, contexts = 16, 8
    counted = count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), buckets, contexts).cache()
    parts = dict([*((r.bucket, r.blob) for r in counted.where(f"kind = {FILTER}").collect()), *((r.bucket, r.blob) for r in context_parts(counted, buckets).collect())])
    size = np.array([len(parts.get(b, b"")) // 8 for b in range(buckets + contexts)])
    filled = np.frombuffer(b"".join(bytes(parts.get(b, b"")) for b in range(buckets + contexts)), np.uint64)
    n, v, often, counts = word_totals(counted.where(f"kind = {COUNTS}"), 1 << 20)
    model = Model(filled, np.cumsum(size) - size, size, bucket_edges(buckets), bucket_edges(contexts), often, counts, n, v, (8.0, 1.0))
    _, pair, triple = keys(*sequence(Words(pa.array(texts)))[:3])
    for key, kind in ((pair, BI), (triple, TRI)):
        names, count = np.unique(key, return_counts=True)
        got = VALUE[model.probe(names, kind)]
        assert (count == 1).any() and (got > 0).all() and np.mean(np.abs(got - count) < 0.5) > 0.9  # levels of counts to three are exact, but for false hits
        context, inverse = np.unique(after(names, AFTER_1 if kind == BI else AFTER_2), return_inverse=True)
        follow = np.bincount(inverse, weights=count - 0.75)
        got = VALUE[model.probe(context, AFTER)] / 4
        assert (got > 0).all() and np.mean(np.abs(np.log(got / follow)) < 0.5) > 0.9


def test_held_out_text_gains_from_what_was_seen_once(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    trained = [i for i in range(2000, 2300) if zlib.crc32(str(i).encode()) % 10]
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.permutation(200)) for _ in trained]
    own = texts[0].split()
    rows = [*zip(trained, texts, strict=True), (held, texts[0])]
    # the same words in an order that no text has
    other = next(i for i in range(held + 1, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows.append((other, " ".join(own[i] for i in rng.permutation(len(own)))))
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    assert got[held] > got[other] + 100  # log10; every trigram of the first was seen, nearly all of them once


def exact_scores(texts, held):
    """The model's log10 probabilities with exact counts where the filter has levels."""
    grams, follow, n_texts = [Counter(), Counter(), Counter()], [Counter(), Counter()], sum(d not in held for d in texts)
    run = lambda t: ["<s>", "<s>", *words(t), None]
    for d, t in texts.items():
        if d not in held:
            for a, b, c in zip(x := run(t), x[1:], x[2:]):
                grams[0][c] += 1
                grams[1][b, c] += 1
                grams[2][a, b, c] += 1
    for (b, c), k in grams[1].items():
        follow[0][b] += k - 0.75
    for (a, b, c), k in grams[2].items():
        follow[1][a, b] += k - 0.75
    n, v, out = sum(grams[0].values()), len(grams[0]), {}
    for d, t in texts.items():
        total = 0.0
        for a, b, c in zip(x := run(t), x[1:], x[2:]):
            p = (grams[0][c] + 0.1) / (n + 0.1 * (v + 1))
            for seen, after, context, damp in ((grams[1][b, c], follow[0][b], grams[0][b], 8.0), (grams[2][a, b, c], follow[1][a, b], grams[1][a, b], 1.0)):
                seen = max(seen - 0.75, 0.0)
                context = (n_texts if b == "<s>" else context) if damp == 8.0 or b == "<s>" else context
                context = max(context, after) + damp
                p = (seen + (context - after) * p) / context
            total += math.log10(p)
        out[d] = total
    return out


def test_scores_against_exact_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    want = exact_scores(texts, held)
    got = {r.doc_id: (r.score, r.n_tokens) for r in score_texts(docs).collect()}
    off = np.array([abs(got[d][0] - want[d]) / got[d][1] for d in texts])  # levels and false hits move a token's log10 by a few hundredths
    assert off.mean() < 0.05 and np.quantile(off, 0.95) < 0.15
    a, b = (np.array([x[d] if isinstance(x[d], float) else x[d][0] for d in texts]) for x in (want, got))
    assert np.corrcoef(a, b)[0, 1] > 0.99


def test_rounds_agree(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").limit(60)
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None), (7, "")], docs.schema)).cache()
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 6), round(r.base_score, 6), r.n_known) for r in df.collect())
    assert key(score_texts(docs, buckets=2)) == key(score_texts(docs, buckets=2, round_mb=0)) == key(score_texts(docs, buckets=2, often_words=5))


def test_filter_is_mapped_from_the_broadcast(spark):
    room, words = filter_room(50_000)
    words[:] = np.arange(50_000, dtype=np.uint64)
    sent = spark.sparkContext.broadcast(room)

    def look(_):
        found = shared_filter(sent, 50_000)
        yield type(found).__name__, int(found.sum()), bool(found.flags.aligned)

    assert spark.sparkContext.parallelize([1], 1).mapPartitions(look).collect() == [("memmap", 50_000 * 49_999 // 2, True)]
    small, words = filter_room(3)
    words[:] = 7
    sent = spark.sparkContext.broadcast(small)
    assert shared_filter(sent, 3).tolist() == [7, 7, 7] and shared_filter(sent, 0).tolist() == []


def test_large_filters_are_not_broadcast(spark, sf_dir, monkeypatch):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").limit(60).cache()
    docs.count()
    sent = []
    monkeypatch.setattr("pyspark.core.context.SparkContext.broadcast", lambda self, value: sent.append(value) or 1 / 0)
    got = score_texts(docs, round_mb=0).count()
    assert got == 60 and not sent  # rounds over the whole table, one for each piece of the filter, aren't needed
