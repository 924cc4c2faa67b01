import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom.functions.cells import is_date_format
from rowloom.operators.cells import with_typed_fields
from rowloom.operators.densify import densify, render_lines
from rowloom.plans.convert import Options, convert_batch, read_text, save_workbooks, text_to_workbooks, workbooks_to_lines
from rowloom.sinks.files import write_files
from rowloom.sinks.naming import free_names
from rowloom.sinks.workbooks import cell_rows, export_workbooks
from rowloom.sources.text_files import literal_path
from rowloom.sources.workbooks import read_workbook_cells, read_workbooks, workbook_cells, workbook_status

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

SHEET_ONE = """<sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row>
<row r="3" spans="1:5"><c r="A3" t="b"><v>1</v></c><c r="B3" s="1"><v>45688</v></c><c r="C3" s="2"><v>45688.6</v></c>
<c r="E3" s="3"><v>123.456</v></c><c r="F3" s="4"><v>0.5</v></c></row>
<row r="4"/>
<row r="5"><c r="B5" t="str"><f>A1&amp;"x"</f><v>a &lt; "b" </v></c><c r="C5"><f>1/3</f><v>0.333333333</v></c>
<c r="D5" t="e"><v>#N/A</v></c><c r="E5" s="9"><v>7</v></c><c r="F5" s="1"><v>9999999</v></c><c r="B5"><v>2</v></c></row>
<row><c><v>1</v></c><c><v>2</v></c></row>
</sheetData>"""
SHEET_TWO = '<x:sheetData><x:row r="1"><x:c r="A1" s="2"><x:v>1,234.5</x:v></x:c><x:c r="AA1" t="s"><x:v>2</x:v></x:c></x:row></x:sheetData>'


def workbook():
    files = {
        "xl/workbook.xml": f'<workbook {MAIN} {REL}><sheets><sheet name="Bl&amp;tt 1" sheetId="7" r:id="rId9"/>'
                           f'<sheet name="Zwei" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet2.xml"/>'
                                      '<Relationship Id="rId9" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {MAIN}><si><t>plain</t></si><si><r><t xml:space="preserve">rich </t></r>'
                                f'<r><rPr><b/></rPr><t>text</t></r></si><si><t>ä;ö</t></si></sst>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts count="2"><numFmt numFmtId="164" formatCode="0.000"/>'
                         '<numFmt numFmtId="165" formatCode="yyyy\\-mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/>'
                         '</cellStyleXfs><cellXfs count="5"><xf numFmtId="0"/><xf numFmtId="14"><alignment/></xf>'
                         '<xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><cols><col min='1'/></cols>{SHEET_ONE}</worksheet>",
        "xl/worksheets/sheet2.xml": f'<x:worksheet xmlns:x="m">{SHEET_TWO}</x:worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for entry, xml in files.items():
            box.writestr(entry, xml)
    return out.getvalue()


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("/d/w.xlsx", bytearray(workbook()))], "path string, content binary")


def by_ref(cells):
    return {(r["sheet"], r["row_seq"] + 1, r["pos"]): (r["kind"], r["text"]) for r in cells.collect()}


def test_stored_cells(files):
    got = by_ref(workbook_cells(files, None))
    one = {(row, pos): v for (s, row, pos), v in got.items() if s == "Bl&tt 1"}
    assert one[1, 0] == ("text", "plain") and one[1, 1] == ("text", "rich text") and one[1, 2] == ("empty", "")
    assert one[2, 0] == ("boolean", "TRUE") and one[2, 1] == ("date", "2025-01-31") == one[2, 2]
    assert one[2, 3] == ("date", "1900-05-02")  # format 164 is taken for a date
    assert one[2, 4] == ("number", "0,5")
    assert one[4, 0] == ("text", 'a < "b" ') and one[4, 1] == ("number", "0,33") and one[4, 2] == ("text", "#N/A")
    assert one[4, 3] == ("number", "7") and one[4, 4] == ("number", "9999999")
    two = {(row, pos): v for (s, row, pos), v in got.items() if s == "Zwei"}
    assert two == {(1, 0): ("date", "1903-05-18"), (1, 1): ("text", "ä;ö")}


def test_format_codes(files):
    got = by_ref(workbook_cells(files, 0, format_code_check=True))
    assert got["Bl&tt 1", 2, 3] == ("number", "123,46") and got["Bl&tt 1", 2, 4] == ("date", "1899-12-30")


def test_lines_of_a_sheet(files):
    rows = workbooks_to_lines(files).orderBy("row").collect()
    assert [r["line"] for r in rows] == [
        '"plain";"rich text";"";""',
        'TRUE;2025-01-31;2025-01-31;"";1900-05-02;0,5',
        '"";"a < ""b"" ";0,33;"#N/A";7;9999999',
        '"";""',
    ]
    every = workbooks_to_lines(files, Options(all_sheets=True, export_separator=",", quote_mode=0)).collect()
    two = [r["line"] for r in every if r["sheet"] == "Zwei"]
    assert two == ["1903-05-18" + "," * 26 + "ä;ö"]


def test_status(spark, files):
    bad = spark.createDataFrame([("bad.xlsx", bytearray(b"zip?"))], "path string, content binary")
    both = files.unionByName(bad)
    status = {r["path"]: (r["status"], r["message"]) for r in workbook_status(both, 0).collect()}
    assert status["/d/w.xlsx"] == ("ok", None) and status["bad.xlsx"][0] == "failed"
    assert workbook_cells(both, 0).select("path").distinct().count() == 1
    third = {r["path"]: r["message"] for r in workbook_status(files, 2).collect()}
    assert third == {"/d/w.xlsx": "no worksheet 2"}


def lines_with_settings(spark, n):
    return spark.range(1, n + 1).select(
        F.lit("src").alias("path"), F.col("id").alias("line_no"),
        F.concat_ws(";", F.col("id"), F.lit('"a<b & ""c"" \x01"'), F.col("id") + 0.25, F.lit("2025-01-31"), F.lit(""),
                    F.lit("x>y")).alias("line"),
        F.lit(";").alias("separator"), F.lit(None).cast("array<string>").alias("overrides"),
    )


def test_export_and_read_again(spark):
    rows = with_typed_fields(lines_with_settings(spark, 250)).select("path", F.col("line_no").alias("row"), "cells")
    books = export_workbooks(rows, rows_per_workbook=100).collect()
    assert sorted(b["chunk"] for b in books) == [0, 1, 2]
    with zipfile.ZipFile(io.BytesIO(books[0]["content"])) as box:
        assert box.testzip() is None and "[Content_Types].xml" in box.namelist()
    back = spark.createDataFrame([(str(b["chunk"]), b["content"]) for b in books], "path string, content binary")
    cells = workbook_cells(back)
    assert cells.count() == 1500
    line = {r["path"]: r["line"] for r in workbooks_to_lines(back).filter("row = 7").collect()}
    assert line["1"] == '107;"a<b & ""c"" �";107,25;2025-01-31;"";"x>y"'
    assert line["2"].startswith("207;")


def test_rows_from_long_cells(spark):
    rows = with_typed_fields(lines_with_settings(spark, 3)).select("path", F.col("line_no").alias("row"), "cells")
    long = rows.select("path", "row", F.posexplode("cells").alias("col", "c")).select("path", "row", "col", "c.*")
    direct = {r["path"]: r["content"] for r in export_workbooks(rows).collect()}
    assert {r["path"]: r["content"] for r in export_workbooks(cell_rows(long)).collect()} == direct


def test_text_to_workbook_files_and_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("\nName;Menge;Datum\nx;5;31.01.2025\n\"y;z\";6,5;q\n\nlast;1;2\n")
    books = text_to_workbooks(read_text(spark, str(source)))
    out = tmp_path / "out"
    out.mkdir()
    for _ in range(2):
        assert [r["status"] for r in save_workbooks(spark, books, str(out)).collect()] == ["ok"]
    assert sorted(p.name for p in out.iterdir()) == ["a.xlsx", "a_1.xlsx"]
    assert [r["status"] for r in save_workbooks(spark, books, str(out), overwrite=True).collect()] == ["ok"]
    cells = read_workbook_cells(spark, str(out / "a.xlsx"))
    got = {r["ref"]: (r["kind"], r["text"]) for r in cells.collect()}
    assert got["A3"] == ("text", "y;z") and got["B3"] == ("text", "6,5") and got["C2"] == ("date", "2025-01-31")
    assert got["A5"] == ("text", "last") and got["B2"] == ("number", "5")
    report = convert_batch(spark, str(out), str(tmp_path / "text"), Options(all_sheets=True, export_encoding="windows-1252"))
    assert [r["status"] for r in report.collect()] == ["ok", "ok"]
    texts = spark.read.text(str(tmp_path / "text" / "lines")).select("value").distinct().collect()
    assert '"y;z";"6,5";"q"' in {r["value"].strip() for r in texts}


def test_densify_without_references(spark):
    df = spark.createDataFrame(
        [("p", 1, None, 0, "text", "a"), ("p", 1, None, 1, "text", "b"), ("p", 2, 0, 0, "text", "c"),
         ("p", 2, 0, 1, "text", "dup"), ("p", 3, 2, 0, "number", "7")],
        "path string, row int, col int, pos int, kind string, text string")
    rows = render_lines(densify(df, ("path", "row"))).orderBy("row").collect()
    assert [r["line"] for r in rows] == ['"";""', '"c";""', '"";"";7']


def test_free_names(spark):
    existing = spark.createDataFrame([("a.xlsx",), ("a_2.xlsx",), ("b_1.xlsx",), ("c.csv",)], "name string")
    asked = [(i, b) for i, b in enumerate(["a", "a", "a", "b", "b", "c", "b_1"])]
    requests = spark.createDataFrame(asked, "path int, base string").withColumn("extension", F.lit(".xlsx"))
    got = [r["name"] for r in free_names(requests, existing).orderBy("path").collect()]
    none = spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([(f"k{i}", b) for i, b in enumerate(["a", "a", "a_1", "a", "a_1"])], "path string, base string")
    names = [r["name"] for r in free_names(asked.withColumn("extension", F.lit("")), none).collect()]
    assert sorted(names) == ["a", "a_1", "a_1_1", "a_2", "a_3"]
    many = spark.range(3000).select(F.col("id").alias("path"), F.lit("x").alias("base"), F.lit(".c").alias("extension"))
    odd = spark.range(0, 2000).select(F.concat(F.lit("x_"), (F.col("id") * 2 + 1).cast("string"), F.lit(".c")).alias("name"))
    free = [r["name"] for r in free_names(many, odd).orderBy("path").collect()]
    expected = [f"x_{n}" for n in range(2, 4000, 2)] + [f"x_{n}" for n in range(4000, 6000)]
    assert free == ["x.c"] + [f"{n}.c" for n in expected][:2999]
    assert got == ["a_1.xlsx", "a_3.xlsx", "a_4.xlsx", "b.xlsx", "b_2.xlsx", "c.xlsx", "b_1_1.xlsx"]


def test_date_format_ids(values):
    assert values(is_date_format, [14, 1], "int") == [True, False]
    assert literal_path("a[b]") == "a\\[b\\]" and read_workbooks is not None


def broken(change):
    """The workbook with one entry changed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook())) as box, zipfile.ZipFile(out, "w") as new:
        for entry in box.namelist():
            new.writestr(entry, change(entry, box.read(entry).decode()))
    return out.getvalue()


def test_a_broken_part_fails_the_workbook_and_no_other(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "good.xlsx").write_bytes(workbook())
    (inbox / "checksum.xlsx").write_bytes(workbook().replace(b"<v>45688</v>", b"<v>45689</v>"))
    changes = {
        "control": lambda e, x: x.replace("plain", "a&#1;b"),
        "strings": lambda e, x: x[:-20] if e.endswith("sharedStrings.xml") else x,
        "row": lambda e, x: x.replace("<v>7</v>", "<v>7</w>"),
    }
    for name, change in changes.items():
        (inbox / f"{name}.xlsx").write_bytes(broken(change))
    report = convert_batch(spark, str(inbox), str(tmp_path / "out"), Options(all_sheets=True)).collect()
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in report}
    assert status == {"good.xlsx": "ok", "checksum.xlsx": "failed", "control.xlsx": "failed", "strings.xlsx": "failed",
                      "row.xlsx": "failed"}
    outputs = [p.name for p in (tmp_path / "out" / "lines" / "batch_id=0").iterdir() if p.is_dir()]
    assert len(outputs) == 2 and all("good_" in o for o in outputs)


def test_sheets_with_names_alike_stay_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    alike = broken(lambda e, x: x.replace("Bl&amp;tt 1", "A B").replace("Zwei", "A_B"))
    (tmp_path / "in" / "w.xlsx").write_bytes(alike)
    convert_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), Options(all_sheets=True))
    lines = tmp_path / "out" / "lines" / "batch_id=0"
    assert len([p for p in lines.iterdir() if p.is_dir()]) == 2


def test_other_content_is_not_overwritten(spark, tmp_path):
    (tmp_path / "_x.xlsx").write_bytes(b"there")
    (tmp_path / "y.xlsx").write_bytes(b"")
    books = spark.createDataFrame(
        [("/a/_x.csv", 0, bytearray(b"new")), ("/a/y.csv", 0, bytearray(b"new"))], "path string, chunk int, content binary")
    report = save_workbooks(spark, books, str(tmp_path)).collect()
    assert sorted((r["name"], r["status"]) for r in report) == [("_x_1.xlsx", "ok"), ("y_1.xlsx", "ok")]
    assert (tmp_path / "_x.xlsx").read_bytes() == b"there" and (tmp_path / "y.xlsx").read_bytes() == b""
    files = books.selectExpr("'_x.xlsx' as name", "content").limit(1)
    assert [r["status"] for r in write_files(files, str(tmp_path), overwrite=False).collect()] == ["failed"]
