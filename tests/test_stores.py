"""Stores that last: results of runs, and the library; personal data against matching pattern by pattern."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import privacy
from tessera.operators.stored_library import StoredLibrary
from tessera.streaming.run_store import RunStore

KEY = ("question_id", "corpus_language", "question_language", "strategy")
RESULT = "question_id string, corpus_language string, question_language string, strategy string, error string, answer string"


def cases(spark, names):
    return spark.createDataFrame([(n, "en", "en", "full") for n in names], ", ".join(f"{k} string" for k in KEY))


def answered(bad=()):
    return lambda df: df.withColumn("error", F.when(F.col("question_id").isin(*bad), "down") if bad else F.lit(None).cast("string")).withColumn("answer", F.concat(F.lit("a"), "question_id"))


def test_runs_write_each_case_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"), RESULT)
    (tmp_path / "in").mkdir()
    put = lambda name, ids: cases(spark, ids).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: spark.readStream.schema(", ".join(f"{k} string" for k in KEY)).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put("a", ["q1", "q2", "q2"])
    store.run(stream(), answered(bad=("q2",)), str(tmp_path / "check")).awaitTermination()
    put("b", ["q2", "q3"])
    put("c", ["q3", "q1"])

    def dies(df):
        return answered()(df).where(F.when(F.col("question_id") == "q3", F.raise_error(F.lit("killed"))).otherwise(F.lit(True)))

    with pytest.raises(Exception, match="killed"):
        store.run(stream(), dies, str(tmp_path / "check")).awaitTermination()
    store.run(stream(), answered(bad=("q3",)), str(tmp_path / "check")).awaitTermination()  # resumed
    got = {r.question_id: r.error for r in store.results().collect()}
    assert got == {"q1": None, "q2": None, "q3": "down"}
    assert store.rows().where("error is null").groupBy("question_id").count().where("count > 1").count() == 0
    store.retry(cases(spark, ["q1", "q2", "q3"]), answered())
    assert {r.question_id: r.error for r in store.results().collect()} == {"q1": None, "q2": None, "q3": None}
    rows = sorted(tuple(r) for r in store.results().collect())
    store.compact()
    assert sorted(tuple(r) for r in store.results().collect()) == rows and store.batches() == []
    store.append(cases(spark, ["q1", "q4"]), answered(), 100)
    store.compact()
    store.compact()
    assert sorted(r.question_id for r in store.results().collect()) == ["q1", "q2", "q3", "q4"] and len(list((tmp_path / "run" / "compacted").iterdir())) == 1


def test_a_batch_cut_off_is_not_there(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"), RESULT)
    store.append(cases(spark, ["q1"]), answered(), 0)
    store.append(cases(spark, ["q2"]), answered(), 2)
    (tmp_path / "run" / "batches" / "number=2" / "_SUCCESS").unlink()
    assert [r.question_id for r in store.results().collect()] == ["q1"]
    store.append(cases(spark, ["q1", "q2"]), answered(), 2)
    assert sorted(r.question_id for r in store.rows().collect()) == ["q1", "q2"]


def files(path):
    return {p.parent.name: p.name for p in path.rglob("*.parquet")}


def test_library_lasts(spark, tmp_path):
    lib = StoredLibrary(spark, str(tmp_path / "lib"), buckets=8)
    texts = spark.createDataFrame([(f"d{i}", f"n{i}.md", f"text {i}") for i in range(40)], "doc_id string, name string, markdown string").withColumn("imported_at", F.lit("2026-01-01").cast("timestamp"))
    assert lib.documents().count() == 0
    lib.add(texts)
    assert lib.documents().count() == 40 and len(files(tmp_path / "lib")) == 8
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    before = files(tmp_path / "lib")
    lib.update(one([("d7", "longer text than before"), ("unknown", "x")], "doc_id string, markdown string"))
    after = files(tmp_path / "lib")
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2  # other buckets keep their files
    row = lib.documents().where("doc_id = 'd7'").first()
    assert (row.markdown, row.character_count, row.token_count) == ("longer text than before", 23, None)
    lib.set_token_counts(one([("d7", 5)], "doc_id string, token_count long"))
    assert lib.documents().where("doc_id = 'd7'").first().token_count == 5 and lib.documents().count() == 40
    in_bucket = [r.doc_id for r in lib._read().where("bucket = 3").collect()]
    assert lib.delete(one([(d,) for d in [*in_bucket, "unknown", None]], "doc_id string")) == len(in_bucket)  # a bucket that becomes empty
    assert lib.documents().count() == 40 - len(in_bucket) and lib.documents().where(F.col("doc_id").isin(in_bucket)).count() == 0
    lib.add(texts.where("doc_id = 'd7'"))
    assert lib.documents().where("doc_id = 'd7'").count() == 1
    broken = one([("d7", None)], "doc_id string, markdown string").withColumn("markdown", F.raise_error(F.lit("no")).cast("string"))
    kept = files(tmp_path / "lib")
    with pytest.raises(Exception, match="no"):
        lib.update(broken)
    assert files(tmp_path / "lib") == kept
    assert lib.clear() == lib.documents().count() + 40 - len(in_bucket) + (1 if "d7" in in_bucket else 0) and lib.documents().count() == 0


def test_personal_data_by_brute_force(spark, sf_dir):
    """Every pattern in order over whole texts, characters marked one by one, on all documents and on texts made of findings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = [(-1, "Mail Ann@b.fi or ann@B.FI; IBAN FI21 1234 5600 0007 85, card 4111 1111 1111 1111 (not 4111 1111 1111 1112),\nid 131052-308T, call +358 40 123 4567 or (09) 123 4567, host 192.168.10.250, sum 1 250 000."), (-2, None), (-3, ""), (-4, "x" * 50 + " a@b.co " + "y" * 50)]
    df = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    want = {}
    for doc, text in [tuple(r) for r in df.collect()]:
        taken = set()
        for category, pattern in privacy.PATTERNS:
            for m in re.finditer(pattern, text or ""):
                value, places = m.group().strip(), set(range(m.start(), m.end()))
                digits = [int(c) for c in value if c.isdecimal()]
                checked = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits)))
                if places & taken or (category == "credit_card" and (len(digits) < 13 or checked % 10)) or (category == "phone" and (len(digits) < 7 or re.fullmatch("[1-9][0-9]{0,2}(?:[   ][0-9]{3})+", value))):
                    continue
                taken |= places
                a, b = max(0, m.start() - 40), m.end() + 40
                around = ("…" if a > 0 else "") + text[a:b].replace("\n", " ") + ("…" if b < len(text) else "")
                first = want.setdefault((doc, value.lower()), [category, value, around, 0])
                first[3] += 1
    got = {(r.doc_id, r.text.lower()): [r.category, r.text, r.context, r["count"]] for r in privacy.scan(df).collect()}
    assert got == want and {c for c, *_ in got.values()} == {c for c, _ in privacy.PATTERNS}


def test_redaction_by_brute_force(spark, sf_dir):
    """All findings of all documents, and proposals beside them, replaced one by one: the longest first, whole words alone, numbered by category."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = privacy.scan(docs).select("doc_id", "text", "category", F.lit(None).cast("string").alias("replacement"), F.xxhash64("text").alias("place"))
    first = docs.where("text is not null").select("doc_id", F.regexp_extract("text", r"[A-Za-z]{5,}", 0).alias("text"), F.lit("person").alias("category"), F.when(F.col("doc_id") % 2 == 0, " XX ").alias("replacement"), F.lit(0).cast("long").alias("place"))
    items = found.unionByName(first)
    own = {}
    for r in items.collect():
        if r.text.strip():
            own.setdefault(r.doc_id, []).append(r)
    want = {}
    for doc, text in [tuple(r) for r in docs.collect()]:
        count, by = {}, []
        for r in sorted(own.get(doc, []), key=lambda r: (-len(r.text.strip()), r.place)):
            given, label = (r.replacement or "").strip(), privacy.PLACEHOLDERS.get(r.category, r.category)
            if not given:
                count[label] = count.get(label, 0) + 1
            by.append((r.text.strip(), given or f"[{label}-{count[label]}]"))
        for item, new in by:
            a = r"(?<!\w)" if item[0].isalnum() else ""
            b = r"(?!\w)" if item[-1].isalnum() else ""
            text = re.sub(a + re.escape(item) + b, lambda _, new=new: new, text, flags=re.IGNORECASE)
        want[doc] = text
    got = {r.doc_id: r.text for r in privacy.redact(docs, items).collect()}
    assert got == want and sum("[" in (t or "") for t in got.values()) > 3
