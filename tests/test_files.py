import contextlib
import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions.charset import CHARSETS, UTF16BE, UTF16LE, decode_raw, encode_raw
from rowloom.plans import file_queries
from rowloom.plans.convert import Options, batch_report, convert_batch, read_text, target_paths, text_to_cells
from rowloom.plans.queries import CHECKSUM_MODULUS
from rowloom.session import (
    SHUFFLE_CLEANUP, checked_broadcast, is_small, materialize, scratch_folder, scratch_path, shared_dir,
)
from rowloom.sinks.text import write_lines
from rowloom.sources import raw_files, text_files
from rowloom.sources.text_files import block_table, list_files, literal_path, read_lines, read_whole_files, stored_scan

TEXT = "Name;Preis\nKäse ö ü ß €;5,50\nÄ;7\n"


@pytest.fixture
def folder(tmp_path):
    box = tmp_path / "in put+[1]"
    box.mkdir()
    (box / "utf8.csv").write_text(TEXT, encoding="utf-8")
    (box / "bom.TXT").write_bytes(b"\xef\xbb\xbf" + TEXT.replace("\n", "\r\n").encode())
    (box / "windows.log").write_bytes(TEXT.replace("\n", "\r").encode("cp1252"))
    (box / "latin9.csv").write_bytes(TEXT.encode("iso8859-15"))
    (box / "utf16.csv").write_bytes(TEXT.encode("utf-16"))
    (box / "empty.csv").write_bytes(b"")
    (box / "blank.csv").write_text("\n\n\na;b\n1;2\n")
    (box / "other.pdf").write_bytes(b"x")
    return box


def name(path):
    return path.rsplit("/", 1)[1]


@pytest.mark.parametrize("whole_bytes", [1 << 24, -1])
def test_charsets_and_lines(spark, folder, whole_bytes):
    path = literal_path(str(folder))
    rows = read_lines(spark, path, whole_file_bytes=whole_bytes).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["line_no"])):
        texts.setdefault(name(r["path"]), []).append(r["line"])
    expected = TEXT.splitlines()
    assert texts["utf8.csv"] == texts["bom.TXT"] == texts["windows.log"] == texts["utf16.csv"] == expected
    assert texts["blank.csv"] == ["", "", "", "a;b", "1;2"]
    assert "other.pdf" not in texts and "empty.csv" not in texts
    given = read_lines(spark, literal_path(str(folder / "latin9.csv")), "ISO-8859-15", whole_file_bytes=whole_bytes)
    assert [r["line"] for r in given.orderBy("line_no").collect()] == expected
    marked = read_lines(spark, literal_path(str(folder / "bom.TXT")), "windows-1252", whole_file_bytes=whole_bytes)
    assert [r["line"] for r in marked.orderBy("line_no").collect()] == expected


@pytest.mark.parametrize("whole_bytes", [1 << 24, -1])
def test_profile_of_files(spark, folder, whole_bytes):
    source = read_text(spark, literal_path(str(folder)), Options(whole_file_bytes=whole_bytes))
    found = {name(r["path"]): r for r in source.profile.collect()}
    assert found["utf8.csv"]["encoding"] == "UTF-8" and found["windows.log"]["encoding"] == "windows-1252"
    assert found["blank.csv"]["start_line"] == 4 and found["blank.csv"]["total_lines"] == 5
    assert found["utf8.csv"]["header_names"] == ["Name", "Preis"] and found["utf16.csv"]["encoding"] == "UTF-16LE"
    cells = {(name(r["path"]), r["ref"]): r["kind"] for r in text_to_cells(source).collect()}
    assert cells["bom.TXT", "B2"] == "decimal" and cells["windows.log", "B3"] == "decimal"
    assert cells["utf16.csv", "B2"] == "decimal" and not any(k[0] == "empty.csv" for k in cells)


def test_line_numbers_over_many_blocks(spark, tmp_path, monkeypatch):
    for k in range(3):
        lines = [f"{k};{i};{'x' * (i % 50)}" for i in range(4000)]
        (tmp_path / f"f{k}.csv").write_bytes("\r\n".join(lines).encode())
    monkeypatch.setattr(text_files, "line_ranges", lambda files: raw_files.line_ranges(files, 8192))
    rows = read_lines(spark, str(tmp_path), whole_file_bytes=-1).collect()
    assert len(rows) == 12000
    assert all(int(r["line"].split(";")[1]) == r["line_no"] - 1 for r in rows)


def test_charset_roundtrip(spark):
    for charset in CHARSETS:
        codec = {"windows-1252": "cp1252"}.get(charset, charset)
        chars = [c for c in map(chr, range(32, 0x2200)) if c.encode(codec, "ignore").decode(codec) == c]
        text = "".join(c for c in chars if not "\x7f" <= c <= "\x9f")
        df = spark.createDataFrame([(text,)], "t string").select(encode_raw(F.col("t"), charset).alias("r"))
        row = df.select(F.col("r").cast("binary").alias("b"), decode_raw(F.col("r"), charset).alias("t")).first()
        assert bytes(row["b"]) == text.encode(codec) and row["t"] == text
    lost = spark.createDataFrame([("aж€",)], "t string").select(encode_raw(F.col("t"), "ISO-8859-1").alias("r")).first()
    assert lost["r"] == "a??"


def test_invalid_bytes_under_a_given_charset(spark, folder):
    path = literal_path(str(folder / "windows.log"))
    lines = [r["line"] for r in read_lines(spark, path, "UTF-8").orderBy("line_no").collect()]
    assert lines[2] == "�;7"
    with pytest.raises(ValueError):
        read_lines(spark, path, "EBCDIC")


def test_listing_and_targets(spark, folder):
    files = list_files(spark, literal_path(str(folder)))
    rows = {name(r["path"]): r for r in target_paths(files, "/out").collect()}
    assert set(rows) == {"utf8.csv", "bom.TXT", "windows.log", "latin9.csv", "utf16.csv", "blank.csv", "empty.csv"}
    assert rows["bom.TXT"]["target"] == "/out/bom.xlsx"


def test_write_lines_in_order(spark, tmp_path):
    rows = [(p, i, f"{p}{i}ä") for p in ("a", "b") for i in range(1, 301)]
    df = spark.createDataFrame(rows, "src string, row int, line string")
    target = tmp_path / "out"
    write_lines(df, str(target), ["row"], ["src"], "windows-1252")
    for p in ("a", "b"):
        parts = sorted((target / f"src={p}").glob("part-*"))
        text = b"".join(f.read_bytes() for f in parts)
        assert text == "".join(f"{p}{i}ä\r\n" for i in range(1, 301)).encode("cp1252")
    write_lines(df.filter("src = 'a'"), str(tmp_path / "bom"), ["row"], bom=True)
    first = sorted((tmp_path / "bom").glob("part-*"))[0].read_bytes()
    assert first.startswith(b"\xef\xbb\xbfa1")
    with pytest.raises(Exception):
        write_lines(df, str(target), ["row"], ["src"])


def test_batch_with_a_bad_file(spark, folder, tmp_path):
    (folder / "bad.xlsx").write_bytes(b"this is no workbook")
    target = tmp_path / "out"
    report = convert_batch(spark, literal_path(str(folder)), str(target))
    status = {name(r["path"]): r["status"] for r in report.collect()}
    assert status.pop("bad.xlsx") == "failed"
    assert set(status.values()) == {"ok"} and len(status) == 7
    assert {r["status"]: r["files"] for r in batch_report(report).collect()} == {"ok": 7, "failed": 1}
    cells = spark.read.parquet(f"{target}/cells/batch_id=0")
    assert cells.select("path").distinct().count() == 6


def test_shared_folder_and_checked_broadcast(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = materialize(spark.range(1000).withColumn("t", F.lit("x" * 100)))
    assert is_small(df) and not is_small(df, 1000)
    assert "broadcast" in checked_broadcast(df)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in checked_broadcast(df, 1000)._jdf.queryExecution().logical().toString()


def test_large_files_are_not_opened_whole(spark, tmp_path):
    (tmp_path / "small.csv").write_text("a;b\n")
    (tmp_path / "large.csv").write_text("a;b\n" * 5000)
    whole = read_whole_files(spark, str(tmp_path), max_bytes=1000)
    assert [name(r["path"]) for r in whole.select("path").collect()] == ["small.csv"]
    assert [r["path"].rsplit("/", 1)[1] for r in stored_scan(spark, str(tmp_path), above_bytes=1000).select("path").distinct().collect()] == ["large.csv"]


def test_typing_large_files_compiles(spark, tmp_path):
    """Also with line numbers, charsets and profile in the same stage."""
    (tmp_path / "a.csv").write_text("id;preis\n1;2,5\n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = text_to_cells(read_text(spark, str(tmp_path), Options(whole_file_bytes=-1)))
        stages = cells._jdf.queryExecution().debug().codegenToSeq()
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_mark_is_written_before_the_first_row_there_is(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z")], "src string, row int, line string")
    write_lines(df.filter("src = 'a'"), str(tmp_path / "one"), ["row"], bom=True)
    first = sorted((tmp_path / "one").glob("part-*"))[0].read_bytes()
    assert first.startswith(b"\xef\xbb\xbfx")
    write_lines(df, str(tmp_path / "two"), ["row"], ["src"], bom=True)
    for folder in ("src=a", "src=b"):
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / "two" / folder).glob("part-*"))).count(b"\xef\xbb\xbf") == 1


def test_lines_of_bytes():
    """Lines of a range are cut as ``bytes.splitlines`` does, and batches keep their numbers."""
    import itertools

    from rowloom.sources.raw_files import _line_batch, _lines

    for n in range(7):
        for letters in itertools.product(b"a\r\n\xe9", repeat=n):
            data, places = _lines(bytes(letters))
            expected = bytes(letters).splitlines()
            rows = _line_batch("p", 4, 1, data, places[1:], None).to_pylist() if len(places) > 1 else []
            assert len(places) - 1 == len(expected)
            assert [(r["seq"], r["raw"]) for r in rows] == list(enumerate(expected))[1:]


def test_blocks_are_counted_without_sorting_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo\r\n\xff\n")
    table = block_table(stored_scan(spark, str(tmp_path / "a.txt")))
    assert table.first()["total_lines"] == 3
    assert "SortAggregate" not in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("charset", ["ISO-8859-1", "ISO-8859-15", "windows-1252"])
def test_every_character_of_a_charset(spark, charset):
    """Each character alone and beside others, ASCII lines among them, as Python's codec says."""
    codec = {"ISO-8859-1": "latin-1", "ISO-8859-15": "iso8859-15", "windows-1252": "cp1252"}[charset]
    defined = [bytes([b]).decode(codec, "ignore") for b in range(256) if b not in (10, 13)]
    texts = [t for c in defined if c for t in (c, f"a{c}é")] + ["", "plain", "中€Š\U0001f600x"]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select(
        "i", encode_raw(F.col("t"), charset).alias("r")).select("i", F.col("r").cast("binary").alias("b"), decode_raw(F.col("r"), charset).alias("t"))
    got = {r["i"]: (bytes(r["b"]), r["t"]) for r in rows.collect()}
    for i, text in enumerate(texts):
        data = text.encode(codec, "replace")
        assert got[i] == (data, data.decode(codec)), text


def test_one_charset_at_a_time(spark, tmp_path, monkeypatch):
    """What charset_files writes for a charset goes when it has been read; of two bytes a character, file by file."""
    random = np.random.default_rng(3)
    texts = ["\n".join("".join(map(chr, random.integers(32, 127, 99))) for _ in range(30)) for _ in range(600)]
    texts += [None, "äö\r\nß\rend\n"]
    size = sum(len(x or "") for x in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(shared_dir(spark).removeprefix("file://"), "rowloom")
    before = set(shared.rglob("*"))
    sizes = []

    def there():
        return sum(f.stat().st_size for f in set(shared.rglob("*")) - before if f.is_file())

    def watched(*args, **named):
        out = read_lines(*args, **named)
        sizes.append(there())
        return out

    monkeypatch.setattr(file_queries, "read_lines", watched)
    cleanup = spark.conf.get(SHUFFLE_CLEANUP)
    rows = file_queries.charset_files(spark, str(tmp_path)).collect()
    lines = [x for text in texts if text for x in re.sub("\r\n?", "\n", text).removesuffix("\n").split("\n")]
    digest = sum(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines) % CHECKSUM_MODULUS
    assert sorted(r["charset"] for r in rows) == sorted([*CHARSETS, UTF16LE, UTF16BE])
    assert {tuple(r)[1:] for r in rows} == {(len(lines), sum(map(len, lines)), digest)}
    # a charset's files, the lines and what is stored to read the files; all charsets together are more than 12 times the texts
    assert len(sizes) == 12 and max(sizes) < 4 * size
    assert not there() and spark.conf.get(SHUFFLE_CLEANUP) == cleanup


@pytest.mark.parametrize("failing", [False, True])
def test_scratch_folder(spark, failing):
    """Paths made in a scratch folder go with it, also those of folders inside and after a failure; others stay."""
    def made(name):
        path = scratch_path(spark, name)
        spark.range(3).write.parquet(path)
        return Path(path.removeprefix("file://"))

    outside = made("outside")
    with contextlib.suppress(OSError):
        with scratch_folder(spark, "outer"):
            first = made("first")
            with scratch_folder(spark, "inner"):
                second = made("second")
            assert first.exists() and not second.exists()
            if failing:
                raise OSError
    assert outside.exists() and not first.exists() and made("later").parent == outside.parent
