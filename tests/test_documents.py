"""Readers, passages, ranking, grounding, personal data, timelines, evaluation and streams on small inputs."""

import math
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators import evaluation, grounding, privacy, retrieval, timeline
from tessera.sources.sections import html_to_markdown, read_sections, url_allowed
from tessera.sources.tables import read_table
from tessera.streaming.runs import scan_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain BLUE")
    (tmp_path / "latin.txt").write_bytes("päivä".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Head\n\nBLUE text")
    (tmp_path / "c.csv").write_text("id;value\n" + "\n".join(f"{i};x|{i}" for i in range(150)))
    (tmp_path / "d.html").write_text('<html><head><title>T</title></head><body><nav>menu</nav><main><h1>BLUE</h1><p hidden>no</p><ul><li>one</li></ul><table><tr><th>a</th></tr><tr><td>1</td></tr></table></main><footer>end</footer></body></html>')
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.zzz").write_text("?")
    (tmp_path / "g.txt").write_text(" \n")
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    zipped(tmp_path / "h.docx", {"word/document.xml": f'<w:document {W}><w:body>{p("Heading1", "Intro")}{p("Normal", "BLUE words")}{p("ListBullet", "one")}{p("ListBullet", "two")}{p("Heading2", "More")}<w:tbl><w:tr><w:tc>{p("x", "a")}</w:tc></w:tr><w:tr><w:tc>{p("x", "1")}</w:tc></w:tr></w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    zipped(tmp_path / "i.xlsx", {"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Sites" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {s}><si><t>Name</t></si><si><t>BLUE</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Cap</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>'})
    a = 'xmlns:p="p" xmlns:a="a"'
    sp = lambda kind, y, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><a:off x="0" y="{y}"/><p:txBody><a:p><a:pPr lvl="1"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    zipped(tmp_path / "j.pptx", {"ppt/slides/slide1.xml": f'<p:sld {a}>{sp("body", 5, "BLUE point")}{sp("title", 1, "Start")}</p:sld>'})
    return tmp_path


def test_readers(spark, folder):
    got = {}
    for r in read_sections(spark, str(folder)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert got["a.txt"][0].markdown == "plain BLUE" and got["latin.txt"][0].markdown == "päivä" and "# Head" in got["b.md"][0].markdown
    assert [r.locator for r in got["c.csv"]] == ["Rows 1-100", "Rows 101-150"] and "x\\|149" in got["c.csv"][1].markdown
    assert got["d.html"][0].title == "T" and got["d.html"][0].markdown == "# BLUE\n\n- one\n\n| a |\n| --- |\n| 1 |"
    assert all(got[f][0].error for f in ("e.docx", "f.zzz", "g.txt"))
    assert [(r.locator, r.markdown) for r in got["h.docx"]] == [("Heading: Intro", "# Intro\n\nBLUE words\n\n- one\n- two"), ("Heading: More", "## More\n\n| a |\n| --- |\n| 1 |")]
    assert got["i.xlsx"][0].locator == "Sheet: Sites" and got["i.xlsx"][0].markdown.splitlines()[2] == "| BLUE |  | 5 |"
    assert got["j.pptx"][0].title.strip() == "Start" and "BLUE point" in got["j.pptx"][0].markdown
    assert html_to_markdown("") == ("", "")


def test_table_with_decimal_commas(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Kohde;Teho MW;Koodi\nA;184,6;001\nB;12,5;002\n")
    df = read_table(spark, str(tmp_path / "t.csv"), ";")
    assert dict(df.dtypes) == {"Kohde": "string", "Teho MW": "double", "Koodi": "string"} and df.agg(F.sum("`Teho MW`")).first()[0] == pytest.approx(197.1)


def test_urls(spark):
    urls = {"https://a.example/x": True, "http://localhost/": False, "http://127.0.0.1:8/": False, "ftp://a.example": False, "http://u:p@a.example/": False, "http://10.1.2.3/": False, "http://172.20.0.1/": False, "nonsense": False, "http://8.8.8.8/": True}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_allowed(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == urls


def test_passages(spark):
    blocks = [" ".join(f"w{i}{j}" for j in range(n)) for i, n in enumerate([5, 5, 5, 30, 2, 2])]
    df = spark.createDataFrame([("d", 1, "P1", "\n\n".join(blocks)), ("d", 2, "P2", "last  one"), ("d", 3, "P3", " \n\n ")], "doc_id string, section_id int, locator string, markdown string")
    got = [(r.order, r.locator, r.text.split("\n\n")) for r in retrieval.passages(df, 12, 1).orderBy("order").collect()]
    assert got == [(0, "P1", blocks[:2]), (1, "P1", blocks[1:3]), (2, "P1", blocks[2:4]), (3, "P1", blocks[4:]), (4, "P2", ["last  one"])]
    flat = [b for r in retrieval.passages(df, 12, 0).orderBy("order").collect() for b in r.text.split("\n\n")]
    assert flat == [*blocks, "last  one"]


def test_bm25_and_budget(spark):
    texts = {0: "solar park solar", 1: "wind park", 2: "nothing here at all", 3: ""}
    chunks = spark.createDataFrame([(1, o, t) for o, t in texts.items()], "doc_id long, order int, text string").withColumn("tokens", retrieval.tokens(F.col("text")))
    queries = spark.createDataFrame([(7, ["solar", "park"]), (8, ["zzz"])], "query_id long, terms array<string>")
    hits = retrieval.bm25(queries, chunks, 5)
    toks = {o: [w for w in t.split() if w not in retrieval.STOP_WORDS] for o, t in texts.items()}
    avg = sum(max(len(t), 1) for t in toks.values()) / 4
    want = {}
    for o, t in toks.items():
        s = 0
        for q in ("solar", "park"):
            df = sum(q in x for x in toks.values())
            tf = Counter(t)[q]
            s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(t), 1) / avg)) if tf else 0
        if s:
            want[o] = round(s, 6)
    assert {r.order: r.score for r in hits.collect()} == pytest.approx(want) and [r.order for r in hits.orderBy("rank").collect()] == sorted(want, key=want.get, reverse=True)
    near = retrieval.with_neighbours(hits, chunks)
    assert {r.order for r in near.collect()} == {0, 1, 2}
    row = retrieval.fill_budget(near, 40).first()
    assert [p.order for p in row.passages] == [0, 1] and row.used == 25
    assert [p.order for p in retrieval.fill_budget(near, 3).first().passages] == [0]  # nothing fits: the best alone


def test_citations(spark):
    sections = spark.createDataFrame([("d", 1, "Page 1", "Page 1", "# Evaluation metrics\n\ntext"), ("d", 2, "Page 12", "Results", "more"), ("d", 3, "Heading: 1. The artificial neuron", "x", "")], "doc_id string, section_id int, locator string, title string, markdown string")
    marks = {"[S1: Page 1]": 1, "[S1: page 12]": 2, "[S1: results]": 2, "[S1: Heading: The artificial neuron]": 3, "[S1 a.pdf: Evaluation metrics]": 1, "[S1: p. 12]": 2, "[S1: Appendix]": None, "[S9: Page 1]": None}
    answers = spark.createDataFrame([(1, "x " + " y ".join(marks) + " [again](S1: Page 1)", ["d"])], "answer_id long, answer string, doc_ids array<string>")
    got = {r.marker: r.section_id for r in grounding.resolve_citations(answers, sections).collect()}
    assert got == marks


def test_answer_rules(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("a<think>b\nc</think>d", X.strip_thinking) == "ad" and one("x<think>open", X.strip_thinking) == "x"
    for text, want in {"The documents do not mention it.": True, "It isn't specified.": True, "Asiakirjoissa ei mainita asiaa.": True, "It is 5.": False, "Not bad.": False}.items():
        assert one(text, X.is_refusal) is want
    assert one("# H\n- One. Two is here.\n| a | b |\n|---|---|\nEnd.", X.units) == ["One.", "Two is here.", "a | b", "End."]
    got = one("The first fact has five words. [S1: Page 1]\nThe second fact has no citation at all.", X.citation_coverage)
    assert [x.cited for x in got] == [True, False]
    assert one("Intro\n- Alpha\n- Beta\nClosing Gamma", X.listed_text) == "Alpha\nBeta"
    match = lambda p, t: spark.createDataFrame([(p, t)], "p string, t string").select(X.matches(F.col("p"), F.col("t")).alias("x")).first().x
    assert match("num:1148", "made 1 148 MWh") and match("num:184.6", "184,6") and not match("num:5", "55") and match("re:ris+i", "RISSI") and match("strasse", "Straße")


def test_personal_data(spark):
    text = "Ann: ann@x.fi, ANN@x.fi, card 4539 1488 0343 6467, bad card 4539 1488 0343 6468, +358 40 123 4567, sum 184 600 000, 192.168.0.1, Annual"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {(r.category, r.text): r["count"] for r in privacy.scan(docs).collect()}
    assert got["email", "ann@x.fi"] == 2 and got["credit_card", "4539 1488 0343 6467"] == 1 and got["phone", "+358 40 123 4567"] == 1 and got["ip_address", "192.168.0.1"] == 1
    assert not any(t in ("184 600 000",) or "6468" in t and c == "credit_card" for c, t in got)
    items = spark.createDataFrame([(1, "Ann", "person", "", 1), (1, "ann@x.fi", "email", "", 2), (1, "192.168.0.1", "ip_address", "$1\\", 3)], "doc_id long, text string, category string, replacement string, place int")
    row = privacy.redact(docs, items).where("doc_id = 1").first()
    assert row.text.startswith("[PERSON-1]: [EMAIL-1], [EMAIL-1], card") and "$1\\" in row.text and row.text.endswith("Annual") and row.mapping["Ann"] == "[PERSON-1]"


def test_timeline(spark):
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(F.coalesce(timeline.parse_iso(F.col("t")), timeline.parse_date_text(F.col("t"))).alias("d")).first().d
    for text, want in {"2026-08-14": (2026, 8, 14), "2026-08": (2026, 8, None), "2026": (2026, None, None), "14.8.2026": (2026, 8, 14), "14 August 2026": (2026, 8, 14), "elokuussa 2026": (2026, 8, None)}.items():
        assert tuple(read(text)) == want
    assert read("2026-02-30") is None and read("soon") is None
    sections = spark.createDataFrame([("d", 1, "Page 1", "The turbine order is due 14 August 2026.\n\nOther."), ("d", 2, "Page 2", "| Meeting | 1.9.2026 |\n| Launch | 5.5.2027 |")], "doc_id string, section_id int, title string, markdown string")
    rows = [
        (1, 1, "2026-08-14", "14 August 2026", "Turbine order", "", "turbine order is due", "d", 1), (1, 2, "2026-09-01", "1.9.2026", "Meeting", "", "", "d", 1), (1, 3, "2027-05-05", "5.5.2027", "Unrelated thing", "", "", "d", 2),
        (1, 4, "2030", "2030", "Gone", "", "", "d", 1), (1, 5, "x", "x", "Bad", "", "", "d", 1), (1, 6, "2026-08-14", "", "turbine order", "", "", "d", 1), (1, 7, "2026-09", "", "Nowhere", "", "", None, None),
    ]
    events = spark.createDataFrame(rows, "set_id int, place int, date string, date_text string, title string, detail string, quote string, doc_id string, section_id int")
    got = {r.place: (r.status, r.section_id) for r in timeline.verify_events(events, sections).collect()}
    assert got == {1: ("verified", 1), 2: ("verified", 2), 3: ("date_elsewhere", 2), 4: ("date_not_in_source", 1), 5: ("invalid_date", 1), 7: ("citation_unresolved", None)}


def test_scores(spark):
    item = "array<struct<name:string,match:array<string>>>"
    items, universe = [("A", ["alpha"]), ("B", ["beta"])], [("A", ["alpha"]), ("B", ["beta"]), ("C", ["gamma"])]
    rows = [(1, "detail", "it is 5,5", ["num:5.5"], None, None), (2, "list", "- Alpha\n- Gamma", None, items, universe), (3, "unanswerable", "This is not mentioned.", None, None, None), (4, "unanswerable", "It is 7.", None, None, None)]
    got = {r.id: (r.score, r.correct, r.found, r.missed, r.extra, r.precision) for r in evaluation.score_answers(spark.createDataFrame(rows, f"id int, category string, answer string, accept array<string>, items {item}, universe {item}")).collect()}
    assert got[1][:2] == (1.0, True) and got[2] == (0.5, False, ["A"], ["B"], ["C"], 0.5) and got[3][:2] == (1.0, True) and got[4][:2] == (0.0, False)


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.fi"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        scan_stream(stream, privacy.scan, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.fi"]


def test_paragraph_units_cut_lines_once(spark):
    units = timeline.paragraph_units(F.col("t"))
    assert str(units).count("\\R") == 1
    rows = ["One\nline.\n\n| a | b |\n| 1 | 2 |\n \n| no table\nat all\r\n\n\n  \n\nlast", "", None]
    got = [r.u for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(units.alias("u")).collect()]
    assert got == [["One line.", "| a | b |", "| 1 | 2 |", "| no table at all", "last"], [], None]
