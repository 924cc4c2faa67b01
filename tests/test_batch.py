"""Batches: a row for every file, one named file per output, failing files alone, UTF-16 and byte ranges."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom.plans import convert
from rowloom.plans.convert import Options, convert_batch, read_text, save_workbooks, text_to_workbooks
from rowloom.session import materialize
from rowloom.sinks.outputs import place_outputs, text_pieces
from rowloom.sources import raw_files, text_files
from rowloom.sources.raw_files import line_ranges, whole_files
from rowloom.sources.stores import every_file, name_pattern
from rowloom.sources.text_files import literal_path, read_lines
from rowloom.sources.workbooks import read_workbook_cells, workbook_status

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def name(path):
    return path.rsplit("/", 1)[1]


def book(sheets, strings=("a", "b;c")):
    """A workbook of ``{sheet name: rows}``; a cell is a number or the index of a shared string as text."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        out.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(
                f'<c r="{chr(65 + c)}{r}"' + (f' t="s"><v>{v}</v></c>' if isinstance(v, str) else f"><v>{v}</v></c>")
                for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            out.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return box.getvalue()


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.csv").write_text("name;price\nx;1,5\n")
    (box / "a.TXT").write_text("name|price\ny|2\n")
    (box / "_hidden.log").write_text("h;1\n")
    (box / ".dot.csv").write_text("d;1\n")
    (box / "empty.csv").write_bytes(b"")
    (box / "wide.csv").write_bytes("ä;ö\r\n1;2".encode("utf-16"))
    (box / "b.xlsx").write_bytes(book({"One": [["0", 1.5], ["1", 2]], "T w/o": [[7]], "Empty": []}))
    (box / "beyond.xlsx").write_bytes(book({"One": [["2"]]}))
    (box / "broken.xlsx").write_bytes(b"no workbook")
    (box / "skip.pdf").write_bytes(b"x")
    return box


def statuses(report):
    return {name(r["path"]): r["status"] for r in report.collect()}


def test_every_file_has_a_row_and_its_files(spark, inbox, tmp_path):
    options = Options(save_files=True, output_folder=str(tmp_path / "files"), all_sheets=True)
    paths = [literal_path(str(inbox)), str(inbox / "gone.csv")]
    report = convert_batch(spark, paths, str(tmp_path / "out"), options)
    rows = {name(r["path"]): r for r in report.collect()}
    assert {k for k, r in rows.items() if r["status"] == "failed"} == {"beyond.xlsx", "broken.xlsx", "gone.csv"}
    assert len(rows) == 10 and "not there" in rows["gone.csv"]["message"] and "shared strings" in rows["beyond.xlsx"]["message"]
    files = {k: [name(f) for f in r["files"]] for k, r in rows.items() if r["files"]}
    assert sorted(files["a.csv"] + files["a.TXT"]) == ["a.xlsx", "a_1.xlsx"]
    assert files["b.xlsx"] == ["b_Empty.csv", "b_One.csv", "b_T_w_o.csv"]
    assert files["_hidden.log"] == ["_hidden.xlsx"] and files[".dot.csv"] == [".dot.xlsx"]
    there = {p.name: p for p in (tmp_path / "files").iterdir()}
    assert sorted(there) == sorted(n for names in files.values() for n in names)
    assert there["b_One.csv"].read_bytes() == b'"a";1,5\r\n"b;c";2\r\n' and there["b_Empty.csv"].read_bytes() == b""
    assert there["b_T_w_o.csv"].read_bytes() == b"7\r\n"
    back = read_workbook_cells(spark, literal_path(str(there["wide.xlsx"]))).collect()
    assert [(r["ref"], r["text"]) for r in sorted(back, key=lambda r: (r["row"], r["col"]))] == [
        ("A1", "ä"), ("B1", "ö"), ("A2", "1"), ("B2", "2")]
    empty = workbook_status(every_file(spark, str(there["empty.xlsx"])).select("path")).first()
    assert empty["status"] == "ok"


def test_names_next_to_the_source_never_replace_unasked(spark, inbox, tmp_path):
    (inbox / "a.xlsx").write_bytes(book({"S": [[1]]}))
    (inbox / "b.csv").write_text("mine")
    report = convert_batch(spark, str(inbox), str(tmp_path / "one"), Options(save_files=True))
    files = {name(r["path"]): [name(f) for f in r["files"]] for r in report.collect()}
    assert sorted(files["a.csv"] + files["a.TXT"]) == ["a_1.xlsx", "a_2.xlsx"] and files["b.xlsx"] == ["b_1.csv"]
    assert (inbox / "b.csv").read_text() == "mine"
    content = {p.name: p.read_bytes() for p in inbox.iterdir() if p.is_file()}
    again = convert_batch(spark, [str(inbox / "a.csv"), str(inbox / "a.TXT"), str(inbox / "b.xlsx")], str(tmp_path / "one"),
                          Options(save_files=True), overwrite=True)  # the same batch: the same names
    assert {name(r["path"]): [name(f) for f in r["files"]] for r in again.collect()} == {k: files[k] for k in ("a.csv", "a.TXT", "b.xlsx")}
    assert {p.name for p in inbox.iterdir()} == set(content)
    with pytest.raises(FileExistsError):
        convert_batch(spark, str(inbox), str(tmp_path / "one"))


def test_overwrite_spares_the_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;2\n")
    (tmp_path / "x.xlsx").write_bytes(book({"S": [[5]]}))
    (tmp_path / "y.csv").write_text("3\n")
    (tmp_path / "y.xlsx").write_bytes(b"old")
    before = (tmp_path / "x.xlsx").read_bytes()
    report = convert_batch(spark, [str(tmp_path / n) for n in ("x.csv", "x.xlsx", "y.csv")], str(tmp_path / "out"),
                           Options(save_files=True, overwrite_files=True))
    files = {name(r["path"]): [name(f) for f in r["files"]] for r in report.collect()}
    assert files == {"x.csv": ["x_1.xlsx"], "x.xlsx": ["x_1.csv"], "y.csv": ["y.xlsx"]}
    assert (tmp_path / "x.xlsx").read_bytes() == before and (tmp_path / "y.xlsx").read_bytes() != b"old"


def test_one_gone_and_one_hostile_among_a_hundred(spark, tmp_path, monkeypatch):
    for i in range(98):
        (tmp_path / f"f{i}.csv").write_text(f"{i};x\n")
    (tmp_path / "hostile.csv").write_text("h;x\n")
    (tmp_path / "gone.csv").write_text("g;x\n")
    plain, calls = convert._convert, []

    def hostile(spark, files, *rest):
        calls.append(1)
        plain(spark, files, *rest)  # it may have written much before it fails
        if not files.filter("path like '%hostile.csv'").isEmpty():
            raise RuntimeError("a worker has died")

    monkeypatch.setattr(convert, "_convert", hostile)
    files = materialize(text_files.list_files(spark, str(tmp_path)))
    (tmp_path / "gone.csv").unlink()
    report = convert_batch(spark, files, str(tmp_path / "out"), Options(header=False))
    rows = report.collect()
    assert sorted(name(r["path"]) for r in rows if r["status"] == "failed") == ["gone.csv", "hostile.csv"]
    assert sum(r["status"] == "ok" for r in rows) == 98 and len(rows) == 100
    cells = spark.read.parquet(str(tmp_path / "out" / "cells" / "batch_id=0"))
    assert cells.count() == 2 * 98 and len(calls) < 30
    assert not list((tmp_path / "out" / "_attempts").glob("*/report"))


def test_a_failure_of_all_files_is_raised(spark, tmp_path, monkeypatch):
    for i in range(64):
        (tmp_path / f"f{i}.csv").write_text("x\n")
    monkeypatch.setattr(convert, "_convert", lambda *args: (_ for _ in ()).throw(OSError("no space left")))
    with pytest.raises(OSError, match="no space"):
        convert_batch(spark, str(tmp_path), str(tmp_path / "out"))


def test_many_tasks_write_one_text(spark, tmp_path):
    rows = [(k, i, f"{k}{i}ß") for k in ("big", "small") for i in range(5000 if k == "big" else 3)]
    df = spark.createDataFrame(rows, "key string, row long, line string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = text_pieces(df, "windows-1252")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.filter("key = 'big'").count() > 1
    names = spark.createDataFrame([(k, str(tmp_path / f"{k}.csv"), False) for k in ("big", "small", "none")], "key string, file string, own boolean")
    for again in range(2):  # a task that runs again finds what it has written
        placed = place_outputs(names, pieces, overwrite=False).collect()
        assert {r["status"] for r in placed} == {"ok"}
    for k, n in (("big", 5000), ("small", 3), ("none", 0)):
        assert (tmp_path / f"{k}.csv").read_bytes() == "".join(f"{k}{i}ß\r\n" for i in range(n)).encode("cp1252")
    (tmp_path / "small.csv").write_text("other")
    failed = {r["key"]: r["status"] for r in place_outputs(names, pieces, overwrite=False).collect()}
    assert failed == {"big": "ok", "small": "failed", "none": "ok"} and (tmp_path / "small.csv").read_text() == "other"
    assert not list(tmp_path.glob("*.part"))


def test_byte_order_mark_of_text_outputs(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book({"S": [[1]], "E": []}))
    convert_batch(spark, str(tmp_path / "b.xlsx"), str(tmp_path / "out"), Options(save_files=True, all_sheets=True, export_bom=True))
    assert (tmp_path / "b_S.csv").read_bytes() == b"\xef\xbb\xbf1\r\n" and (tmp_path / "b_E.csv").read_bytes() == b"\xef\xbb\xbf"


ENDS = ["\n", "\r\n", "\r"]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_give_each_line_once(spark, tmp_path, seed):
    """Any range, any charset, any mix of line ends: the lines of the whole text."""
    rng = random.Random(seed)
    expected = {}
    for i in range(30):
        text = "".join("".join(rng.choices("abä€਍ഊ;", k=rng.randrange(12))) + rng.choice([*ENDS, ""]) for _ in range(rng.randrange(40)))
        charset = rng.choice(["utf-8", "utf-8-sig", "utf-16", "utf-16-be"])
        data = text.encode(charset) if charset != "utf-16-be" else b"\xfe\xff" + text.encode(charset)
        (tmp_path / f"{i}.txt").write_bytes(data)
        lines = re.split("\r\n|\r|\n", text)
        expected[f"{i}.txt"] = lines[:-1] if lines[-1] == "" else lines
    files = materialize(text_files.list_files(spark, str(tmp_path)))
    for size in (2, 3, 16, 50, 1 << 20):
        got = {}
        for r in sorted(line_ranges(files, size).collect(), key=lambda r: (r["path"], r["block"], r["seq"])):
            assert r["message"] is None
            got.setdefault(name(r["path"]), []).append(bytes(r["raw"]).decode())
        assert got == {k: v for k, v in expected.items() if v}
    whole = {name(r["path"]): r for r in whole_files(files).collect()}
    assert {k: re.split("\r\n|\r|\n", bytes(r["raw"]).decode()) for k, r in whole.items()} == {
        k: v + [""] if bytes(whole[k]["raw"])[-1:] in (b"\r", b"\n", b"") and v else v or [""] for k, v in expected.items()}


@pytest.mark.parametrize("whole_bytes", [1 << 24, -1])
def test_a_file_that_cannot_be_read_is_a_failure(spark, tmp_path, whole_bytes):
    for n in ("a.csv", "b.csv"):
        (tmp_path / n).write_text("1;2\n")
    files = materialize(text_files.list_files(spark, str(tmp_path)))
    (tmp_path / "b.csv").unlink()
    source = read_text(spark, files, Options(whole_file_bytes=whole_bytes, header=False))
    assert [name(r["path"]) for r in source.failures.collect()] == ["b.csv"]
    assert {name(r["path"]) for r in source.profile.collect()} == {"a.csv"}
    assert [r["line"] for r in read_lines(spark, files, whole_file_bytes=whole_bytes).collect()] == ["1;2"]


def test_listing(spark, tmp_path):
    for n in ("a/x.csv", "a/_y.csv", "a/b/z.csv", "c/x.txt", "c/[1].csv", "c/{2}.csv"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")

    def found(paths, recursive=False):
        return sorted(r["path"].rsplit(tmp_path.name + "/", 1)[1] for r in every_file(spark, paths, recursive).collect())

    root = str(tmp_path)
    assert found(root) == [] and found(f"{root}/a") == ["a/_y.csv", "a/x.csv"]
    assert found(root, True) == ["a/_y.csv", "a/b/z.csv", "a/x.csv", "c/[1].csv", "c/x.txt", "c/{2}.csv"]
    assert found(f"{root}/*/x.*") == ["a/x.csv", "c/x.txt"] and found(f"{root}/[ab]/*y*") == ["a/_y.csv"]
    assert found([f"{root}/a", f"{root}/a/x.csv"]) == ["a/_y.csv", "a/x.csv"]
    assert found(literal_path(f"{root}/c/[1].csv")) == ["c/[1].csv"] and found(f"{root}/c/*.{{csv,txt}}") == ["c/[1].csv", "c/x.txt", "c/{2}.csv"]
    missing = every_file(spark, f"{root}/none.csv").first()
    assert missing["message"] == "the file is not there" and found(f"{root}/none*") == []


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("a*b", ["ab", "a.b"], ["abc"]), ("?", ["x"], ["", "xy"]), ("[!a]", ["b"], ["a"]), ("{a,bc}x", ["ax", "bcx"], ["abcx"]),
    (r"\*", ["*"], ["x"]), ("a.b", ["a.b"], ["axb"]), ("[", ["["], [""]), ("x,y", ["x,y"], ["x"]),
])
def test_patterns(glob, yes, no):
    assert all(re.fullmatch(name_pattern(glob), x) for x in yes)
    assert not any(re.fullmatch(name_pattern(glob), x) for x in no)


def test_workbooks_of_many_chunks_as_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text("".join(f"{i};t\n" for i in range(25)))
    options = Options(save_files=True, header=False, rows_per_workbook=10)
    report = convert_batch(spark, str(tmp_path / "long.csv"), str(tmp_path / "out"), options).first()
    assert [name(f) for f in report["files"]] == ["long-2.xlsx", "long-3.xlsx", "long.xlsx"]
    direct = text_to_workbooks(read_text(spark, str(tmp_path / "long.csv"), options), options, 10)
    saved = save_workbooks(spark, direct, str(tmp_path / "direct")).collect()
    for row in saved:
        one, two = (zipfile.ZipFile(tmp_path / d / row["name"]) for d in (".", "direct"))
        assert {n: one.read(n) for n in one.namelist()} == {n: two.read(n) for n in two.namelist()}
    assert raw_files.RANGE_BYTES % 2 == 0 and F is not None
