"""Suites, saved runs and libraries read from JSON, lists of documents in order, texts written, and plain rules of the text functions."""

import json

from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.functions import translation
from tessera.operators import context, library, retrieval, suites, timeline
from tessera.sources.sinks import write_text

SUITE = {
    "name": "s", "version": "1", "document_order": ["report", "table"], "documents": {"report": {"en": "r.md", "fi": "r-fi.md"}, "table": {"en": "t.csv", "fi": "t.csv"}}, "universes": {"sites": {"A": ["alpha"]}},
    "questions": [
        {"id": "q1", "category": "detail", "question": {"en": "How much?", "fi": "Paljonko?"}, "answer": ["num:5"], "evidence": [{"doc": "report", "locator": None, "locators": {"en": "Page 1", "fi": "Sivu 1"}}]},
        {"id": "q2", "category": "list", "cross": True, "difficulty": "hard", "universe": "sites", "question": {"en": "Which?"}, "items": [{"name": "A", "match": ["alpha"], "evidence": [{"doc": "table", "locator": "Rows 1-2"}]}, {"name": "B", "match": ["beta"], "evidence": [{"doc": "table", "locator": "Rows 9-9"}]}]},
        {"id": "q3", "category": "unanswerable", "question": {"en": "Who?"}},
    ],
}


def test_suite_from_json(spark, tmp_path):
    (tmp_path / "suite.json").write_text(json.dumps(SUITE))
    suite = suites.load_suite(spark, str(tmp_path / "suite.json"))
    assert [(r.question_id, r.place, r.difficulty, r.cross) for r in suite["questions"].orderBy("place").collect()] == [("q1", 0, "standard", False), ("q2", 1, "hard", True), ("q3", 2, "standard", False)]
    assert [(r.doc, r.files["fi"]) for r in suite["documents"].orderBy("place").collect()] == [("report", "r-fi.md"), ("table", "t.csv")]
    wanted = suites.targets(suite, ["en", "fi"])
    assert {(r.language, r.label, r.locator) for r in wanted.collect()} == {("en", "q1", "Page 1"), ("fi", "q1", "Sivu 1"), *((lang, f"q2/{i}", loc) for lang in ("en", "fi") for i, loc in (("A", "Rows 1-2"), ("B", "Rows 9-9")))}
    corpora = spark.createDataFrame([(lang, d, loc, text) for lang, page in (("en", "Page 1"), ("fi", "Sivu 2")) for d, loc, text in (("report", page, "It is 5,0 MW."), ("table", "Rows 1-2", "Alpha"))], "language string, doc string, locator string, markdown string")
    problems = {(r.language, r.label, r.problem) for r in suites.self_check(wanted, corpora).collect()}
    assert problems == {("fi", "q1", "locator not found"), ("fi", "q1", "answer not found"), *((lang, "q2/B", p) for lang in ("en", "fi") for p in ("locator not found", "answer not found"))}


def test_saved_runs_and_best(spark, tmp_path):
    for name, start, done in (("run-1", "2026-01-01", 5), ("run-2", "2026-02-01", 9), ("../x", "2026-03-01", 1)):
        (tmp_path / f"{start}.json").write_text(json.dumps({"id": name, "started_at": start, "model": "m", "completed_cases": done}))
    assert [r.id for r in suites.saved_runs(spark, str(tmp_path)).collect()] == ["run-2", "run-1"]


def test_library_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": "a", "name": "A", "status": "ready", "markdown": "words", "character_count": 5, "imported_at": "2026-01-02T00:00:00"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"name": "no id"}))
    docs = library.load(spark, str(tmp_path))
    assert [r.doc_id for r in docs.collect()] == ["a"]
    wanted = spark.createDataFrame([(1, ["z", "a", "a"])], "set_id long, doc_ids array<string>")
    assert [(r.doc_id, r.found) for r in library.by_ids(docs, wanted).orderBy("place").collect()] == [("z", False), ("a", True), ("a", True)]
    write_text(docs, str(tmp_path / "out"), "markdown")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["words"]


def test_names_and_evidence(spark):
    one = lambda f, *t: spark.createDataFrame([t], ", ".join(f"c{k} string" for k in range(len(t)))).select(f(*(F.col(f"c{k}") for k in range(len(t)))).alias("x")).first().x
    names = {"a/b\\c: d?.txt": "c_ d_.txt", "con.txt": "_con.txt", " .. ": "", "x\u00a0y\x00z": "x y_z", "n" * 200: "n" * 150}
    assert {n: one(X.file_name, n) for n in names} == names and one(lambda c: X.file_name(c, "file"), "..") == "file"
    assert one(X.extension, "A.Report.PDF") == "pdf" and one(X.extension, ".hidden") == "" and one(lambda c: X.slug(c, "none"), " --Ääni & valo! ") == "Ääni_valo"
    passage = "Intro words here.\n\n| Site | MW |\n|---|---|\n| Pohjankangas | 184,6 |\n| Kivijärvi | 12 |\n\nPohjankangas closing."
    assert tuple(one(X.best_evidence, passage, "Pohjankankaan teho on 184,6 MW")) == (1, 0) and one(X.best_evidence, passage, "xyz") is None
    assert one(lambda t: X.flag_numbers(t, F.array(F.lit("1 148"), F.lit("7"))), "1 148 and 71, 7.5 and 7") == "[1 148](flag:0) and 71, 7.5 and [7](flag:1)"
    assert one(lambda a: X.backed_statement(a, F.lit("[S1: p]")), "One. Two **is** here [S1: p] end") == "Two  is  here" and one(lambda a: X.backed_statement(a, F.lit("[S9: p]")), "One.") == ""


def test_translation_marks(spark):
    text = "It grew [S1: Page 2] and fell (see [words](S2: Row 3))."
    row = spark.createDataFrame([(text,)], "t string").select(translation.protect(F.col("t")).alias("p")).first().p
    assert row.marks == ["[S1: Page 2]", "[S2: Row 3]"] and "[[C1]]" in row.text and "[[C2]]" in row.text
    back = spark.createDataFrame([("Se [[C1]] [[c 1]] [[C7]] ", row.marks)], "t string, m array<string>").select(translation.restore(F.col("t"), F.col("m")).alias("r")).first().r
    assert back.text == "Se [S1: Page 2] [S1: Page 2]\n\n[S2: Row 3]" and (back.kept, back.reattached) == (1, 1)


def test_dates_of_no_document_are_looked_for_in_all(spark):
    sections = spark.createDataFrame([("d", 1, "Page 1", "Nothing."), ("e", 4, "Page 4", "The grid connection was ready on 3.5.2024."), ("f", 2, "Page 2", "Grid connection 2024-05-03 again.")], "doc_id string, section_id int, title string, markdown string")
    events = spark.createDataFrame([(1, 1, "2024-05-03", "3.5.2024", "Grid connection", "", "", None, None), (1, 2, "2024-05-03", "", "Grid connection done", "", "", "d", 1)], "set_id int, place int, date string, date_text string, title string, detail string, quote string, doc_id string, section_id int")
    members = spark.createDataFrame([(1, x) for x in "def"], "set_id int, doc_id string")
    got = {r.place: (r.status, r.doc_id, r.section_id) for r in timeline.verify_events(events, sections, members).collect()}
    assert got == {1: ("verified", "e", 4), 2: ("date_not_in_source", "d", 1)}


def test_terms_and_strategies(spark):
    row = spark.createDataFrame([("Käyttöönottopäivä on 日本 the end",)], "t string").select(retrieval.tokens(F.col("t"), F.lit("fi")).alias("fi"), retrieval.tokens(F.col("t")).alias("plain")).first()
    assert row.plain == ["käyttöönottopäivä", "日", "本", "end"] and row.fi == ["käyttöönottopäivä", "~käyttö", "日", "本", "end"]
    rows = [(1, 100, 500, [400, 300], 1000), (2, 100, 5000, [2000, 900, 400], 1000), (3, 100, 5000, [9000] * 4, 1000)]
    s = spark.createDataFrame(rows, "i int, characters int, full_tokens int, tokens_at array<int>, allowed int").withColumn("max_characters", F.lit(12000))
    got = {r.i: (r.strategy, r.budget, r.fits) for r in context.auto_strategy(s).collect()}
    assert got == {1: ("full", None, True), 2: ("retrieval", 7200, True), 3: ("retrieval", 2591, False)}  # 0.6 to the third is a little under 0.216
    assert {r.strategy for r in context.auto_strategy(s, 50).collect()} == {"retrieval"}
