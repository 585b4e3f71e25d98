"""Each operator against a brute-force version, or its rules and held-out accuracy, on small tables and odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.licenses import find_licences, scan_licences
from tessera.llm.lines import dedup_lines
from tessera.llm.lm import score_texts
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.pstable import near_vectors
from tessera.llm.quality import quality_scores
from tessera.llm.scratch import read
from tessera.llm.simhash import simhash_components
from tessera.llm.toxicity import toxicity_scores
from tessera.llm.vptree import nearest

SPACE = re.compile(r"[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_text = "\n".join(f"line {i} of a very long text with words w{i} v{i} u{i}" for i in range(4000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "", 0),
        (4, "one two three four five six seven", None, "a", 3), (5, long_text, "en", "b", None), (6, "x" * 30000, "fr", "b", 1), (7, " \t\n", "en", "b", 1), (None, "no id at all in this row", "en", "c", 2),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("score", "label", "size", "copies", "n_removed", "component_id", "bucket", "held_out", "predicted", "piece")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_lm_scores_base_and_model(spark, docs, texts):
    counts, total = Counter(), 0
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update([*words(t), None])
    total, v = sum(counts.values()), len(counts)
    rows = score_texts(docs).collect()
    assert len(rows) == len(texts)
    held = []
    for r in rows:
        ws = [*words(texts[r.doc_id]), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_tokens == len(ws) and r.n_known == sum(counts[w] > 0 for w in ws) and r.train_tokens == total
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
        if r.held_out:
            held.append((r.score, r.base_score, r.n_tokens))
    assert sum(h[0] for h in held) > sum(h[1] for h in held)  # better than the base on texts not seen


def test_lm_scores_odd_rows(odd, none):
    rows = score_texts(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3, 7)} == {1}
    assert score_texts(none).count() == 0


def accuracy(rows, label, held=True):
    pairs = [(r.score, label[r.doc_id]) for r in rows if r.doc_id in label and r.held_out == held]
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"  # the smaller tables have a few dozen toxic rows to learn from, too few
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = quality_scores(docs.select("doc_id", "text"), labels).collect()
    assert accuracy(rows, quality) > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    rows = toxicity_scores(docs, labels).collect()
    assert accuracy(rows, toxic) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_classifiers_see_text_and_allowed_labels_alone(spark, docs, sf_dir):
    labels = read(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    flipped = flipped.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rows: {r.doc_id: round(r.score, 12) for r in rows}
    assert key(quality_scores(docs.select("doc_id", "text"), labels).collect()) == key(quality_scores(docs.select("doc_id", "text"), flipped).collect())
    assert key(toxicity_scores(docs, labels).collect()) == key(toxicity_scores(docs.withColumn("source", F.lit("z")), flipped).collect())


def test_classifiers_odd_rows(spark, odd, none, sf_dir):
    labels = read(spark, sf_dir, "labels")
    for f in (lambda x: quality_scores(x, labels), lambda x: toxicity_scores(x, labels), lambda x: quality_scores(x, labels.limit(0)), lambda x: toxicity_scores(x, labels.limit(0))):
        rows = f(odd).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert f(none).count() == 0


def test_licences(spark, odd, none):
    mit = (
        "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.\nIN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.'
    )
    found, known, _ = find_licences(mit)
    assert [x[0] for x in found] == ["MIT"] and known >= 4 and mit[found[0][1] : found[0][2]].strip().startswith("Permission")
    cases = {
        "// SPDX-License-Identifier: Apache-2.0": ["SPDX:apache-2.0"], "This work is licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"], "Licensed under the Apache License, Version 2.0": ["Apache-2.0"],
        "Nothing here.": [], "A license of our own applies.": [], "Released under the MIT license. Released under the 3-clause BSD license.": ["MIT", "BSD-3-Clause"],
    }
    rows = scan_licences(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: [x.licence for x in r.licences] for r in rows} == dict(enumerate(cases.values()))
    assert len(scan_licences(odd).collect()) == odd.count() and scan_licences(none).count() == 0


def test_nearest_by_brute_force(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    rows = df.collect()
    ids, vecs = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.op4_vptree(spark, sf_dir).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    exact = defaultdict(list)
    for r in nearest(df, df.where("vec_id % 100 = 0"), factor=1.0).collect():
        exact[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        dist = np.sqrt(((vecs - vecs[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, dist)) if ids[i] != q][:10]
        assert [x[1] for x in sorted(exact[q])] == ids[order].tolist()
        assert [x[2] for x in sorted(exact[q])] == pytest.approx(dist[order].tolist(), rel=1e-9)
        hits += len({x[1] for x in got[q]} & set(ids[order].tolist()))
        total += len(order)
    assert hits >= 0.9 * total


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (8, [0.01, 1.0], None), (9, [1.0, 0.0, 0.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).withColumn("rank", F.lit("clash"))


def test_vectors_odd_rows(spark):
    df = odd_vectors(spark)
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(df, df.where("vec_id = 0"), factor=1.0).collect()}
    assert got[0, 1] == 1 and set(got.values()) == {1, 7, 8}
    rows = near_vectors(df).collect()
    by = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert len(rows) == 11 and by[0] == (1, 0) and by[1] == (1, 0) and by[8][1] == 7 and by[2] == (0, 2) and by[3] == (0, 3) and by[9] == (0, 9)
    assert near_vectors(df.limit(0)).count() == 0 and nearest(df.limit(0), df.limit(0)).count() == 0


def test_near_vectors_by_brute_force(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    near = np.argwhere(np.triu(v @ v.T >= 0.95, 1))
    root = components(len(ids), near.tolist())
    got = {r.vec_id: r for r in queries.op6_pstable(spark, sf_dir).collect()}
    links = Counter(near.ravel().tolist())
    order = {i: min(ids[j] for j in range(len(ids)) if root[j] == root[i]) for i in range(len(ids))}
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(near)
    assert all(got[ids[i]].n_links <= links[i] and got[ids[i]].kept == (got[ids[i]].component_id == ids[i]) for i in range(len(ids)))
    assert np.mean([got[ids[i]].component_id == order[i] for i in range(len(ids))]) > 0.98


def brute_removed(rows, min_words=5):
    lines = sorted({(d, k, line) for d, t in rows if t is not None and d is not None for k, line in enumerate(t.split("\n"))})
    sets = [(d, k, frozenset(words(line))) for d, k, line in lines]
    sets = [s for s in sets if len(s[2]) >= min_words]
    gone, by_word = set(), defaultdict(list)
    for at, (d, k, s) in enumerate(sets):
        shared = Counter(i for w in s for i in by_word[w])
        if any(5 * n >= 4 * (len(s) + len(sets[i][2]) - n) and sets[i][:2] != (d, k) for i, n in shared.items()):
            gone.add((d, k))
        for w in s:
            by_word[w].append(at)
    return gone


def test_line_dedup_by_brute_force(spark, docs, texts, odd, none):
    for df, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        gone = brute_removed(rows, 1)
        out = dedup_lines(df).collect()
        assert len(out) == len(rows)
        for r, (d, t) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda x: (x[0] is None, x[0])), strict=True):
            want = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone)
            assert r.doc_id == d and r.text == want and r.n_removed == sum(g[0] == d for g in gone)
    assert dedup_lines(none).count() == 0


def brute_fingerprint(text):
    ws = words(text)
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))] if ws else []
    bits = np.zeros(64, int)
    for s in shingles:
        bits += np.array([xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash_by_brute_force(spark, docs, texts, odd, none):
    for df, rows in ((docs, sorted(texts.items())), (odd.where("doc_id is not null"), sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None}, key=lambda x: x[0]))):
        prints = [brute_fingerprint(t) for _, t in rows]
        root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df).collect()}
        assert got == {d: (f"{prints[i]:016x}", rows[root[i]][0]) for i, (d, _) in enumerate(rows)}
    assert simhash_components(none).count() == 0


def test_mixing(spark, docs, texts, odd, none):
    rows = mixed(docs).collect()
    sizes = {d: len([w for w in SPACE.split(t or "") if w]) for d, t in texts.items()}
    total = sum(sizes.values())
    by = defaultdict(int)
    for r in rows:
        by[r.source] += sizes[r.doc_id]
    left, target, weights = 1.5 * total, {}, dict(zip(sorted(by, key=lambda s: (s is None, s)), [5, 2, 1] * len(by)))
    while True:
        open_ = {s: w for s, w in weights.items() if s not in target}
        part = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in part if part[s] > 2 * by[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2.0 * by[s]
            left -= target[s]
    taken = defaultdict(int)
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == by[r.source] and 0 <= r.copies <= 2 and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.copies * r.size
    for s in by:  # within half a document of the shortest class, those of under 256 words
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 128)
    again = {r.doc_id: r.copies for r in mixed(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert mixed(odd).count() == odd.count() and mixed(none).count() == 0


def test_packing(spark, docs, texts, odd, none):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df, rows in ((docs, list(texts.items())), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), [(r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None])):
        out = pack(df).collect()
        by = defaultdict(list)
        for r in out:
            by[r.doc_id].append(r)
        for d, t in rows:
            ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
            got = sorted(by[d], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length) for r in got] == [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
            assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()) for s in range(0, len(ids), 2048)]
        filled = defaultdict(list)
        for r in out:
            filled[r.sequence_id].append((r.offset, r.length))
        for parts in filled.values():
            parts.sort()
            assert [p[0] for p in parts] == np.concatenate([[0], np.cumsum([p[1] for p in parts])[:-1]]).tolist() and sum(p[1] for p in parts) <= 2048
        total = sum(r.length for r in out)
        assert len(filled) <= 1.05 * -(-total // 2048) + 1
    assert pack(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and pack(none).count() == 0
