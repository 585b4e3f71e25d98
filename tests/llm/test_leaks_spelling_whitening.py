"""Decontamination, spelling variants and whitening against brute force, on the given tables and on odd rows."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.decontaminate import contamination, overlaps
from tessera.llm.scratch import read
from tessera.llm.spelling import variants, word_counts
from tessera.llm.whitening import fit_whitening, identity_error, whitening_table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, wid string, win string, n string, h string, word string, id string, w string, copies string"


def items_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(docs, items):
    """(doc_id, words, sorted hit places, sorted items) by looking every sequence up."""
    held = defaultdict(set)
    for item, text in items:
        w = items_words(text)
        for i in range(max(len(w) - 10, 0) + 1) if w else ():
            held[tuple(w[i : i + 10])].add(item)
    sizes, out = {len(k) for k in held}, []
    for doc, text in docs:
        w, places, found = items_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in held:
                    places.update(range(i, i + size))
                    found |= held[tuple(w[i : i + size])] - {None}
        out.append((doc, len(w), sorted(places), sorted(map(str, found))))
    return sorted(out, key=str)


def placed(df):
    return sorted(((r.doc_id, r.n_words, [p for s in r.spans for p in range(s.begin, s.end)], r["items"]) for r in df.collect()), key=str)


PASSAGE = "The quick brown fox jumps over the lazy dog while seven old owls look on in doubt"
ODD_ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "Short item"), (3, None), (4, ""), (5, " .,- "), (None, "one item without any number at all stands here for once"), (6, "É é same words"), (7, "to be or not to be"), (8, PASSAGE.upper() + " and more words follow here at the end")]


def odd_docs():
    lorem = " ".join(f"w{i % 977}" for i in range(40000))
    texts = [
        (1, f"intro {PASSAGE} outro {PASSAGE.lower()}"), (1, "a short ITEM here"), (1, "a short ITEM here"), (2, None), (3, ""), (4, " \n.,"), (5, f"{lorem} {PASSAGE} {lorem} short, item"), (6, "one item without any number at all stands here, for once"),
        (None, "É-é same words"), (None, "é é same words"), (8, "to be or not to be or not to be or not to be"), (9, PASSAGE[:40]), (10, "short"), (11, "item short item short item"),
    ]
    return texts


def test_overlaps_odd_rows(spark):
    docs = spark.createDataFrame([(*t, *["clash"] * 8) for t in odd_docs()], DOCS)
    items = spark.createDataFrame([(*t, "x") for t in ODD_ITEMS], "item_id long, text string, wid string")
    want = hits(odd_docs(), ODD_ITEMS)
    assert placed(overlaps(docs, items)) == want
    assert placed(overlaps(docs, items, broadcast_bytes=0)) == want  # tables that are too large to send
    assert placed(overlaps(docs, items, shingle=2)) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, none).collect()} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert contamination(docs, none).count() == docs.count() and contamination(docs.limit(0), items).count() == 0


def test_one_hot_passage(spark):
    """The same passage in every document, and one document's id on a third of all rows."""
    texts = [(i if i % 3 else 0, f"{'x ' * (i % 7)}{PASSAGE} y{i}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    assert placed(overlaps(docs, spark.createDataFrame(ODD_ITEMS, "item_id long, text string"))) == hits(texts, ODD_ITEMS)


def test_decontamination_is_native(spark, sf_dir, capsys):
    queries.op12_decontamination(spark, sf_dir).explain()
    assert not re.search(r"Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)


def garbled_counts(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}


def grouped(count):
    """(word, n, form, root, n_near, form_n) by patterns of one letter left out or masked."""
    same, near = defaultdict(set), defaultdict(set)
    for w in count:
        same[w].add(w)
        for i in range(len(w)):
            same[w[:i] + w[i + 1 :]].add(w)
            same[w[:i] + "\0" + w[i + 1 :]].add(w)
    for k, ws in same.items():
        for a in ws:
            near[a] |= {b for b in ws if a != b and ("\0" in k or k in (a, b))}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-count[v], v))
            if count[best] >= 10 * count[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, form.get(w) or "", root(w), len(near[w]), count.get(form.get(w), 0)) for w, n in count.items())


def listed(df):
    return sorted((r.word, r.n, r.form or "", r.root, r.n_near, r.form_n or 0) for r in df.collect())


def test_spelling_by_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    count = garbled_counts(docs.select("doc_id", "text").collect())
    words = word_counts(docs)
    assert {r.word: r.n for r in words.collect()} == count
    want = grouped(count)
    for most in (128, 1):  # whole buckets, and all cut to one open letter
        assert listed(variants(words, most=most)) == want


def test_variants_one_edit_apart(spark):
    """Every edit at every place of words of all lengths, chains of forms, ties, one hot beginning, and a very long word."""
    rng = np.random.default_rng(3)
    count = {}
    for size in range(1, 14):
        w = "".join(rng.choice(list("abcdeéÿ"), size))
        for i in range(size + 1):
            for v in (w, w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :]):
                if v:
                    count[v] = int(rng.choice([1, 1, 2, 10, 100, 1000]))
    count |= {"commonbeginning" + "".join(p): 1 for p in np.array(np.meshgrid(list("abcdefgh"), list("abcdefgh"), list("abcdefgh"))).T.reshape(-1, 3)}
    count |= {"x" * 30000: 50, "x" * 30001: 5, "x" * 29999 + "y": 5}
    df = spark.createDataFrame([(w, n, "clash") for w, n in count.items()], "word string, n int, form string")
    small = {w: n for w, n in count.items() if len(w) < 1000}
    want = grouped(small) + [("x" * 30000, 50, "", "x" * 30000, 2, 0), ("x" * 30001, 5, "x" * 30000, "x" * 30000, 1, 50), ("x" * 29999 + "y", 5, "x" * 30000, "x" * 30000, 1, 50)]
    for most in (128, 8):
        assert listed(variants(df, most=most)) == sorted(want)


def test_spelling_odd_rows(spark):
    texts = [(1, "Éclairée éclairée Éclairée ECLAIRER straßen×÷ straßen×÷ " * 3), (None, "lettering lettering"), (2, None), (3, ""), (1, "lettering, letterings; letterings"), (4, "long" * 9000 + " " + "long" * 9000), (1, "same row same row"), (1, "same row same row")]
    docs = spark.createDataFrame([(*t, *["clash"] * 8) for t in texts], DOCS)
    words = word_counts(docs)
    assert {r.word: r.n for r in words.collect()} == garbled_counts(texts)
    assert listed(variants(words)) == grouped(garbled_counts(texts))
    assert variants(word_counts(docs.limit(0))).count() == 0


def eigen(x):
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    return e[::-1], u[:, ::-1], c


def test_whitening_of_embeddings(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    rows = df.collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    n, e, u, c = len(x), *eigen(x.astype(float) - 1_000_000)
    want = c @ u[:, :32] / np.sqrt(e[:32])
    got = defaultdict(dict)
    for r in whitening_table(df).collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-12 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    assert len(got) == n and all(list(sorted(g)) == list(range(1, 33)) for g in got.values())
    w = np.array([[got[r.vec_id][j].whitened for j in range(1, 33)] for r in rows])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    assert [got[r.vec_id][1].deviation for r in rows] == ((n * x - x.sum(0)) ** 2).sum(1).tolist()


def test_whitening_takes_several_passes(spark):
    """More dimensions than the blocks hold: blocks are replaced by Ritz vectors, and the residuals end the passes."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 150)) * np.exp(-np.arange(150) / 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).cache()
    e, u, _ = eigen(np.floor(64 * x))
    fit = fit_whitening(df, k=8, more=4, kept=3)
    assert fit.passes > 3 and fit.residual < 1e-13 and identity_error(df, fit) < 1e-9
    assert fit.values == pytest.approx(e[:8], rel=1e-11) and np.abs((fit.vectors * u[:, :8]).sum(0)) == pytest.approx(np.ones(8), abs=1e-11)
    with pytest.raises(ArithmeticError):
        fit_whitening(df, k=8, more=4, most_passes=2)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (None, [0.5, -0.2, 0.1]), (4, [0.0, 0.0, 0.0]), (5, [-3.0, 2.0, 7.5]), (5, [1e4, -0.5, 0.25])]
    odd = [(6, None), (7, []), (8, [0.1, None, 0.2]), (9, [nan, 0.1, 0.2]), (10, [inf, 0.0, 0.1]), (11, [1.0, 2.0]), (12, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in sound + odd], "vec_id long, embedding array<double>, whitened double, component string")
    x = np.floor(64 * np.array([v for _, v in sound])).astype(int)
    rows = whitening_table(df).collect()
    e = eigen(x.astype(float))[0]
    assert sorted({(-1 if r.vec_id is None else r.vec_id) for r in rows}) == [-1, 1, 4, 5] and len(rows) == len(sound) * 3 == len(sound) * int((e > 1e-12 * e[0]).sum())
    assert {r.deviation for r in rows} == {int(d) for d in ((6 * x - x.sum(0)) ** 2).sum(1)} and max(r.identity_error for r in rows) < 1e-6
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id > 5 and vec_id < 11")):  # nothing, no variance, no whole vector
        assert whitening_table(few).count() == 0
    assert whitening_table(df.where("vec_id = 11 or vec_id = 1")).count() == 0  # the commonest length wins, and its vectors are equal
    huge = spark.createDataFrame([(i, [float((-1) ** i * 30_000_000)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening_table(huge).collect()} == {None} or all(r.deviation == (4 * 64 * 30_000_000) ** 2 for r in whitening_table(huge).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def test_extra_columns_stay_out(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumns({c: F.lit("clash") for c in ("pos", "h", "begin", "th", "run", "key", "len")})
    assert contamination(df, read(spark, sf_dir, "benchmark").withColumn("off", F.lit(0))).count() == df.count()
    assert word_counts(df).count() == word_counts(df.select("doc_id", "text")).count()
