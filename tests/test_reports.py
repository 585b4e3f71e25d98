"""Pages without their navigation, reports of runs as Markdown, selection and order of cases, deletion of runs, and model JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.model_json import json_problems
from tessera.operators import evaluation, suites
from tessera.sources.sections import html_to_markdown

PAGE = """<html><head><title>Site</title><meta name="description" content="What it is about"></head><body>
<div class="top-menu"><ul><li>Home</li><li>Shop</li></ul></div>
<div id="cookie"><span>We use cookies</span></div>
<div class="sidebar"><h2>Kept since it has a heading</h2></div>
<section role="banner">Buy now<div class="inner">more</div></section>
<p style="visibility: hidden">unseen</p><p style="color: red">seen</p><textarea>typed</textarea><canvas>drawn</canvas>
<div class="advertising">not an ad by its name</div><!-- note -->
<div class="ads"><table><tr><td>a</td><td>b</td></tr></table></div></body></html>"""


def test_navigation_goes():
    title, text = html_to_markdown(PAGE)
    assert title == "Site" and [b for b in text.split("\n\n")] == ["## Kept since it has a heading", "seen", "not an ad by its name", "| a | b |\n| --- | --- |"]
    assert html_to_markdown("<head><meta property='og:description' content=' All of it '></head><body><nav>x</nav></body>") == ("", "All of it")
    assert html_to_markdown("<body><div class=menu><main>inside</main></div><div>after</div>") == ("", "after")
    assert html_to_markdown("<div class=menu>never closed<p>text") == ("", "never closed\n\ntext")


def summary(run, key, share, **more):
    return {"run": run, "key": key, **dict.fromkeys(suites.MEASURES, share), "seconds_mean": 2.5, "seconds_total": 90.0, "cases": 4, **more}


def test_run_tables(spark):
    fields = ", ".join(["run string", "key string", *(f"{m} double" for m in suites.MEASURES), "seconds_mean double", "seconds_total double", "cases long"])
    rows = [summary("b", "all", 0.5), summary("a", "all", 0.125, overall=None, seconds_mean=None, seconds_total=59.4), summary("b", "strategy=full", 1.0), summary("other", "all", 0.0)]
    df = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in fields.split(", ")) for r in rows], fields)
    tables = {r.key: r.text.split("\n") for r in suites.run_tables(df, ["a", "b", "absent"]).collect()}
    assert tables["all"][:4] == ["| Metric | a | b |", "|---|---:|---:|", "| Overall | - | 50 % |", "| Small details | 12 % | 50 % |"]
    assert tables["all"][-3:] == ["| Seconds per question | None | 2.5 |", "| Time to complete | 59 s | 1.5 min |", "| Cases | 4 | 4 |"]
    assert tables["strategy=full"][0] == "| Metric | b |" and len(tables["strategy=full"]) == 2 + len(suites.MEASURES) + 3
    line = df.where("run = 'b' and key = 'all'").select(suites.summary_line()).first()[0]
    assert line == "overall 50 % | details 50 % | lists recall 50 % precision 50 % | not-in-documents 50 % | unsupported numbers 50 % | citations correct 50 % | 2.5 s/question | 1.5 min in total"


def test_retrieval_table(spark):
    rows = spark.createDataFrame([(0, False, None, "en", "fi", 0.5, 0.75, 1.0, None, 0.049), (1, True, "hard", "fi", "fi", 0.0, 0.0, 0.005, 1.0, 1.0)], "place int, stemming boolean, tier string, question_language string, corpus string, recall_at_1 double, recall_at_3 double, recall_at_5 double, context_recall double, share_of_corpus_sent double")
    lines = [r.line for r in suites.retrieval_table(rows).orderBy("place").collect()]
    assert len(lines) == 4 and lines[2] == "| plain BM25 | standard | EN -> FI | 50 % | 75 % | 100 % | - | 5 % |" and lines[3] == "| language-aware | hard | FI -> FI | 0 % | 0 % | 0 % | 100 % | 100 % |"


def test_selection_and_order_of_cases(spark):
    q = spark.createDataFrame([(f"q{i}", i, ["detail", "list"][i % 2], ["standard", "hard"][i // 3 % 2], i == 0) for i in range(9)], "question_id string, place int, category string, difficulty string, cross boolean")
    ids = lambda **k: [r.question_id for r in suites.selected(q, **k).orderBy("place").collect()]
    assert ids() == [f"q{i}" for i in range(9)] and ids(per_category=1) == ["q0", "q1"] and ids(categories=["list"], difficulties=["hard"]) == ["q3", "q5"] and ids(ids=["q8", "q2"]) == ["q2", "q8"]
    assert ids(categories=["detail"], per_category=2) == ["q0", "q2"]
    order = evaluation.cases(suites.selected(q, ids=["q0", "q1"]), ["fi", "en"], ["search", "full"]).orderBy(*suites.case_order(["fi", "en"], ["search", "full"])).collect()
    assert [(r.corpus_language, r.strategy, r.question_id, r.question_language) for r in order] == [(c, s, n, x) for c, o in (("fi", "en"), ("en", "fi")) for s in ("search", "full") for n, x in (("q0", c), ("q1", c), ("q0", o))]


def test_documents_by_language(spark):
    df = spark.createDataFrame([("b", 1, {"en": "b.md"}), ("a", 0, {"en": "a.md", "fi": "a-fi.md"})], "doc string, place int, files map<string,string>")
    assert {r.language: r.docs for r in suites.documents_by_language(df).collect()} == {"en": ["a", "b"], "fi": ["a"]}


def test_runs_are_deleted(spark, tmp_path):
    (tmp_path / "run-1.json").write_text(json.dumps({"id": "run-1", "started_at": "x"}))
    (tmp_path / "keep.txt").write_text("")
    for bad in ("../keep", "nowhere", "", "keep.txt/"):
        with pytest.raises(KeyError):
            suites.delete_run(spark, str(tmp_path), bad)
    suites.delete_run(spark, str(tmp_path), "run-1")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["keep.txt"]


def test_json_problems(spark):
    schema = {"name": "string", "n": "integer?", "list?": [{"k": "number"}], "any": "any", "ok?": "boolean"}
    texts = {
        '{"name":"a","n":1,"any":null}': [], '{"name":"a","n":null,"any":[1],"list":[],"ok":true}': [], '{"name":"a","n":1.5,"any":0,"list":[{"k":1},{"k":2.5},{"k":"x"},7,{"k":1,"z":0}]}': ["$.n: no integer", "$.list[2].k: no number", "$.list[3]: no object", "$.list[4].z: extra"],
        '{"more":1,"also":2}': ["$.also: extra", "$.more: extra", "$.name: missing", "$.n: missing", "$.any: missing"], "[1]": ["$: no object"], "null": ["$: no object"], "": ["$: no JSON"], "{": ["$: no JSON"], '{"name":"a","n":1,"any":1,"ok":"yes","list":{}}': ["$.list: no list", "$.ok: no boolean"],
        '{"name":"a","name":"b","n":1,"any":1}': ["$: no JSON"],
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", json_problems(F.col("t"), schema).alias("p")).collect()
    assert {r.t: r.p for r in rows} == texts | {None: ["$: no JSON"]}
    assert spark.createDataFrame([('["a",1]',)], "t string").select(json_problems(F.col("t"), ["string"])).first()[0] == ["$[1]: no string"]


def test_passages_by_brute_force(spark, sf_dir):
    """Blocks packed one by one at 180 words with one block of overlap, over all documents, titles kept."""
    import re

    from tessera.operators import retrieval

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sections = docs.select("doc_id", F.lit(1).alias("section_id"), F.lit("Text").alias("locator"), F.col("source").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))
    want = {}
    for r in sections.collect():
        blocks = [b.strip("\n") for b in re.split(r"\n[ \t]*\n(?:[ \t]*\n)*", r.markdown or "") if b.strip()]
        packed, held = [], []
        size = lambda bs: sum(len(b.split()) for b in bs)
        for b in blocks:
            if held and size(held) + size([b]) > 180:
                packed.append(held)
                held = held[-1:] if size(held[-1:]) < 180 else []
            held = [*held, b]
        packed += [held] if held else []
        want.update({(r.doc_id, i): ("\n\n".join(p).strip(), r.title) for i, p in enumerate(packed)})
    got = {(r.doc_id, r.order): (r.text.strip(), r.title) for r in retrieval.passages(sections).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0].split() == want[k][0].split() for k in got)


def test_sheets_as_tables(spark, tmp_path):
    from tests.test_readers import R, relations, zipped

    from tessera.sources.tables import read_sheet, sheet_names

    s = f'xmlns="s" {R}'
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    number = lambda at, v: f'<c r="{at}"><v>{v}</v></c>'
    one = f"<row>{text('A1', 'Site')}{text('B1', 'Output')}{text('C1', 'site')}</row><row>{text('A2', 'North')}{number('B2', '5')}</row><row/><row>{text('A3', 'South')}{number('B3', '6.5').replace('<v>', '<f>B2+1.5</f><v>')}{text('C3', 'x')}</row>"
    sheet = lambda rows: f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" r:id="{k}"/>' for n, k in (("Empty", "a"), ("Data", "b"), ("Other", "c")))
    book = {"xl/workbook.xml": f"<workbook {s}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": relations(**{k: ("worksheet", f"worksheets/{k}.xml") for k in "abc"})}
    book |= {"xl/worksheets/a.xml": sheet(""), "xl/worksheets/b.xml": sheet(one), "xl/worksheets/c.xml": sheet(f"<row>{text('A1', 'n')}</row>")}
    path = tmp_path / "book.xlsx"
    path.write_bytes(zipped(book))
    assert [(r.sheet, r.rows, r.formulas) for r in sheet_names(spark, str(path)).orderBy("place").collect()] == [("Empty", 0, 0), ("Data", 3, 1), ("Other", 1, 0)]
    df = read_sheet(spark, str(path))
    assert df.dtypes == [("Site", "string"), ("Output", "double"), ("column 3", "string")] and sorted(map(tuple, df.collect()), key=str) == [("North", 5.0, None), ("South", 6.5, "x")]
    assert read_sheet(spark, str(path), "Other").columns == ["n"] and read_sheet(spark, str(path), "Other").count() == 0
    for bad in ("Empty", "Nowhere"):
        with pytest.raises(ValueError, match=bad):
            read_sheet(spark, str(path), bad)


def test_events_by_locator(spark):
    """A cited locator is resolved to a section before its date is looked for."""
    from tessera.operators import timeline

    sections = spark.createDataFrame([(1, 1, "Page 1", "", "On 3 May 2020 the goods left."), (1, 2, "Page 2", "", "Nothing here.")], "doc_id long, section_id int, locator string, title string, markdown string")
    rows = [(7, 0, "2020-05-03", "", "Goods", "left", "the goods left", 1, "page 1"), (7, 1, "2020-05-03", "3 May", "Goods again", "left", "the goods left", 1, "p. 9"), (7, 2, "2021-01-01", "", "Other", "x", "y", 1, "Page 2")]
    events = spark.createDataFrame(rows, "set_id int, place int, date string, date_text string, title string, detail string, quote string, doc_id long, locator string")
    got = {r.place: (r.status, r.section_id) for r in timeline.verify_events(events, sections).collect()}
    assert got == {0: ("verified", 1), 1: ("verified", 1), 2: ("date_not_in_source", 2)}


def test_encodings():
    from tessera.sources.sections import decode

    text = "Päivä: 5 € – “yes”"
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-32", "cp1252"):
        assert decode(text.encode(name)) == text
    assert decode("plain words".encode("utf-16-le")) == decode("plain words".encode("utf-16-be")) == "plain words"
    assert decode("äö".encode("latin-1")) == "äö" and decode(b"") == "" and decode(b"\x81\x8d") == "\x81\x8d"


def test_plans_are_normalised():
    from tessera.plans.query_plan import Aggregate, Chart, Computed, Filter, PlanError, QueryPlan, Sort, normalised, plan_from_json

    columns = ["Region name", "units", "price"]
    plan = QueryPlan([Computed("total", "units * price")], [Filter("UNITS", ">", "1")], "region", [Aggregate("sum", "Total"), Aggregate("count", alias="amount")], ["region_name", "sum total"], [Sort("Amount")], 3, Chart("bar", "region", "SUM_total"))
    done = normalised(plan, columns)
    assert (done.filters[0].column, done.group_by, done.select, done.sort[0].column, done.chart) == ("units", "Region name", ["Region name", "sum_total"], "amount", Chart("bar", "Region name", "sum_total"))
    assert normalised(QueryPlan(group_by="region", chart=Chart("line", "units", "nothing")), columns) == QueryPlan()
    assert normalised(QueryPlan(aggregates=[Aggregate("avg", "price")], chart=Chart("bar", "units", "avg_price")), columns).chart == Chart()
    with pytest.raises(PlanError, match="select"):
        normalised(QueryPlan(select=["weight"]), columns)
    assert plan_from_json('{"chart": {"type": "line", "x": "a", "y": "b"}}').chart == Chart("line", "a", "b")
    for bad in ('{"chart": {"type": "pie"}}', '{"chart": {"kind": "bar"}}', '{"chart": 5}'):
        with pytest.raises(PlanError):
            plan_from_json(bad)


def test_expected_numbers_and_cited_evidence(spark):
    from tessera.operators import grounding

    sections = spark.createDataFrame([(10, 1, "Page 1", "", "Intro.\n\nThe mill made 40 tonnes of paper in 2021.\n\n| Site | Output |\n| --- | --- |\n| North | 15 |\n| South | 25 |")], "doc_id long, section_id int, locator string, title string, markdown string")
    answers = spark.createDataFrame([(1, "In 2021 the mill made 40 tonnes of paper [S1: Page 1]. South had 25 of output [S1: page 1]. The difference is 999 [S1: Nowhere].", "?", [10], ["num:999", "re:x"])], "answer_id int, answer string, question string, doc_ids array<long>, expected array<string>")
    assert [r.token for r in grounding.unsupported(answers, sections).collect()] == [] and [r.token for r in grounding.unsupported(answers.drop("expected"), sections).collect()] == ["999"]
    found = grounding.cited_evidence(answers, grounding.resolve_citations(answers, sections), sections).collect()
    assert {(r.marker, r.evidence.block, r.evidence.row) for r in found} == {("[S1: Page 1]", 1, None), ("[S1: page 1]", 2, 1)}
