"""Office files with text boxes, merged cells, dates, charts, notes, and slides out of their files' order; mixed columns; plans as JSON."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.plans.query_plan import Aggregate, Filter, PlanError, QueryPlan, chart_series, execute, plan_from_json, profile_values
from tessera.sources.sections import read_csv, read_docx, read_pptx, read_xlsx
from tessera.sources.tables import csv_sections, read_table, table_info

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="{REL}/{kind}" Target="{t}"/>' for k, (kind, t) in targets.items()) + "</Relationships>"


def test_docx_boxes_once_and_merged_cells():
    w = 'xmlns:w="w" xmlns:mc="mc" xmlns:v="v"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    box = f"<w:txbxContent>{p('Boxed words')}{p('More')}</w:txbxContent>"
    anchored = f"<w:p><w:r><w:t>Anchor</w:t><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback><w:pict><v:textbox>{box}</v:textbox></w:pict></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    cell = lambda t, x="": f"<w:tc><w:tcPr>{x}</w:tcPr>{p(t)}</w:tc>"
    top, below = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('long', top)}{cell('1')}</w:tr><w:tr>{cell('long', below)}{cell('2')}</w:tr></w:tbl>"
    found = read_docx(zipped({"word/document.xml": f"<w:document {w}><w:body>{anchored}<w:sdt><w:sdtContent>{p('Field')}</w:sdtContent></w:sdt>{table}</w:body></w:document>"}))
    assert found[0][2] == "Anchor\n\nBoxed words\n\nMore\n\nField\n\n| a | b |\n| --- | --- |\n| long | 1 |\n|  | 2 |"


def test_xlsx_dates_and_numbers():
    s = f'xmlns="s" {R}'
    cell = lambda at, v, style=0: f'<c r="{at}" s="{style}"><v>{v}</v></c>'
    styles = f'<styleSheet {s}><numFmts><numFmt numFmtId="170" formatCode="d.m.yyyy"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs></styleSheet>'
    rows = f"<row>{cell('A1', 46023)}{cell('B1', 46023, 1)}{cell('C1', 46023.75, 2)}{cell('D1', 3, 3)}{cell('E1', 0.5, 4)}{cell('F1', '7.0')}</row>"
    book = {"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(a=("worksheet", "worksheets/x.xml")), "xl/styles.xml": styles, "xl/worksheets/x.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>"}
    assert read_xlsx(zipped(book))[0][2].splitlines()[0] == "| 46023 | 2026-01-01 00:00:00 | 2026-01-01 18:00:00 | 3 | 12:00:00 | 7 |"


def test_pptx_order_charts_and_notes():
    a = f'xmlns:p="p" xmlns:a="a" xmlns:c="c" {R}'
    slide = lambda t, more="": f'<p:sld {a}><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>{more}<p:pic/></p:sld>'
    pt = lambda k, v: f'<c:pt idx="{k}"><c:v>{v}</c:v></c:pt>'
    chart = f"<c:chartSpace {a}><c:chart><c:title><a:t>Output</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx>{pt(0, 'Wind')}</c:tx><c:cat>{pt(0, '2024')}{pt(1, '2025')}</c:cat><c:val>{pt(0, '5.0')}{pt(1, '6.5')}</c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"
    files = {
        "ppt/presentation.xml": f'<p:presentation {a}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(r1=("slide", "slides/slide1.xml"), r2=("slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("Second"), "ppt/slides/slide2.xml": slide("First", '<p:graphicFrame><c:chart r:id="c1"/></p:graphicFrame>'),
        "ppt/slides/_rels/slide2.xml.rels": relations(c1=("chart", "../charts/chart7.xml"), n1=("notesSlide", "../notesSlides/n.xml")), "ppt/charts/chart7.xml": chart,
        "ppt/notesSlides/n.xml": f'<p:notes {a}><p:sp><p:ph type="sldNum"/><a:p><a:t>1</a:t></a:p></p:sp><p:sp><p:ph type="body"/><a:p><a:t>Say this.</a:t></a:p></p:sp></p:notes>',
    }
    first, second = read_pptx(zipped(files))
    assert first[1] == "Slide 1" and "First" in first[2] and "### Chart: Output\n\n| Category | Wind |\n| --- | --- |\n| 2024 | 5 |\n| 2025 | 6.5 |" in first[2]
    assert "### Speaker notes\n\nSay this." in first[2] and "1 image(s)" in first[2] and "Second" in second[2] and "notes" not in second[2]


def test_mixed_columns_lose_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("site;mw;code\n" + "\n".join(f"s{i};{i},5;{i}" for i in range(8)) + "\nx;n/a;007\ny;;9\n")
    df = read_table(spark, str(tmp_path / "t.csv"), ";")
    assert dict(df.dtypes) == {"site": "string", "mw": "string", "code": "string"}
    cells = {r.site: (r.mw, r.code) for r in df.collect()}
    assert cells["x"] == ("n/a", "007") and cells["y"] == (None, "9") and cells["s3"] == ("3.5", "3")
    got = execute(df, QueryPlan(aggregates=[Aggregate("sum", "mw", "total"), Aggregate("max", "code", "top")])).first()
    assert got.total == pytest.approx(32.0) and got.top == 9
    columns, n, rows = table_info(df, 2, ["site"])
    assert columns == ["site", "mw", "code"] and n == 10 and [r.site for r in rows.collect()] == ["s0", "s1"]


def test_large_doubles_are_plain_text(spark):
    df = spark.createDataFrame([(12345678.0,), (12345678.25,), (5.0,), (1e300,)], "x double")
    n = lambda op, v: execute(df, QueryPlan(filters=[Filter("x", op, v)])).count()
    assert (n("in", "12345678.0"), n("contains", "12345678"), n("contains", ".25"), n("in", "5.0"), n("contains", "e300")) == (1, 2, 1, 1, 1)


def test_plans_as_json(spark):
    plan = plan_from_json('Here:\n```json\n{"group_by": "k", "aggregates": [{"func": "sum", "column": "v", "alias": "s"}], "sort": [{"column": "s"}], "limit": 2}\n```')
    df = spark.createDataFrame([("a", 1), ("b", 5), ("a", 2)], "k string, v int")
    assert [tuple(r) for r in execute(df, plan).collect()] == [("b", 5), ("a", 3)]
    assert plan_from_json('{"group_by": "k"}').group_by == ""
    for bad in ("no plan", '{"where": 1}', '{"filters": [{"column": "k", "op": "~", "value": "x"}]}', '{"filters": [{"col": "k"}]}', '{"aggregates": [{"func": "median", "column": "v"}]}'):
        with pytest.raises(PlanError):
            plan_from_json(bad)


def test_values_and_chart(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", float("nan")), (3, "x", -1.0), (4, None, None)], "i int, t string, v double")
    assert [tuple(r) for r in profile_values(df, ["i"]).collect()] == [("t", ["x", "y"])] and profile_values(df, ["i"], 1).count() == 0
    points, axis = chart_series(df, "t", "v")
    assert points.count() == 2 and tuple(axis.first()) == (2.0, -1.0, 3.0, 2)
    assert points.where(F.col("y") == 2).first().x == "x"


def test_large_csv_files_by_splits(spark, tmp_path):
    for name, n in (("a", 257), ("b", 100), ("c", 0)):
        (tmp_path / f"{name}.csv").write_text("id;value\n" + "".join(f"{i};x|{i}\n" + (";\n" if i % 50 == 7 else "") for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = {}
        for r in csv_sections(spark, str(tmp_path), ";").collect():
            found[r.path.rsplit("/", 1)[1], r.section_id] = (r.locator, r.markdown)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: v[0] for k, v in found.items()} == {("a.csv", 1): "Rows 1-100", ("a.csv", 2): "Rows 101-200", ("a.csv", 3): "Rows 201-257", ("b.csv", 1): "Rows 1-100", ("c.csv", 1): "Header only"}
    for (name, section), (locator, markdown) in found.items():
        if name != "c.csv":
            want = {s[1]: s[2] for s in read_csv((tmp_path / name).read_bytes())}
            assert want[locator] == markdown
