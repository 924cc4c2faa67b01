"""Workbooks: containers unzipped in Python, everything after that as joins on DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.parsers.expat import ParserCreate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.cells import BOOLEAN, SHARED, STRING, is_date_format, stored_kind, stored_text
from rowloom.functions.numbers import finite, lenient_or_overflow
from rowloom.functions.dates import serial_date
from rowloom.functions.refs import ref_column
from rowloom.session import checked_broadcast, is_small, materialize, scratch_path
from rowloom.sources.stores import reason, store_of
from rowloom.sources.text_files import WORKBOOK_TYPES, list_files

PART_SCHEMA = "path string, part string, entry string, seq bigint, xml string"
ROW_SCHEMA = "_r bigint, c array<struct<_r:string,_s:int,_t:string,v:string>>"
XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}

# Where the parts of a workbook live, and the elements read from each.
ENTRIES = {
    "sheet": (r"(^|/)workbook\.xml$", "sheet", None),
    "rel": (r"(^|/)workbook\.xml\.rels$", "Relationship", None),
    "si": (r"(^|/)sharedStrings\.xml$", "si", None),
    "xf": (r"(^|/)styles\.xml$", "xf", "cellXfs"),
    "numFmt": (r"(^|/)styles\.xml$", "numFmt", "numFmts"),
    "row": (r"(^|/)worksheets/[^/]+\.xml$", "row", None),
}

_CHUNK = 1 << 20
_BATCH = 2000


def _elements(stream, tag: str, within: str | None) -> Iterator[str]:
    """The XML of each ``tag`` element of a stream, read piece by piece.

    The whole stream must be well-formed, else this ends with an error.
    """
    check = ParserCreate()
    name = r"(?:[\w.-]+:)?" + tag
    element = re.compile(rf"<{name}(?:\s[^>]*?)?(?:/>|>.*?</{name}\s*>)".encode(), re.S)
    opening = re.compile(rf"<{name}[\s/>]".encode())
    if within is not None:
        outer = re.compile(rf"<(?:[\w.-]+:)?{within}[\s>].*?</(?:[\w.-]+:)?{within}\s*>".encode(), re.S)
        whole = stream.read()
        check.Parse(whole, True)
        check = None
        section = outer.search(whole)
        stream = io.BytesIO(section.group() if section else b"")
    pending = b""
    while chunk := stream.read(_CHUNK):
        if check is not None:
            check.Parse(chunk, False)
        pending += chunk
        done = 0
        for match in element.finditer(pending):
            yield match.group().decode("utf-8", "replace")
            done = match.end()
        begun = opening.search(pending, done)
        # Keep an element that has begun, else the few bytes that may be part of its name.
        pending = pending[begun.start():] if begun else pending[max(done, len(pending) - 64):]
    if check is not None:
        check.Parse(b"", True)


def _open(path: str, content: bytes | None) -> Any:
    """A container by its bytes, or by its path."""
    if content is not None:
        return io.BytesIO(content)
    system, place = store_of(path)
    return system.open_input_file(place)


def _unzip_one(path: str, content: bytes | None, parts: tuple[str, ...]) -> Iterator[tuple]:
    try:
        with _open(path, content) as source, zipfile.ZipFile(source) as box:
            for part in parts:
                pattern, tag, within = ENTRIES[part]
                for entry in box.namelist():
                    if re.search(pattern, entry):
                        with box.open(entry) as stream:
                            for seq, xml in enumerate(_elements(stream, tag, within)):
                                yield path, part, entry.lstrip("/"), seq, xml
    except Exception as problem:  # a bad container is one error row, not a failed job
        yield path, "error", None, 0, reason(problem)


def workbook_parts(files: DataFrame, *parts: str) -> DataFrame:
    """``(path, part, entry, seq, xml)`` of ``files(path[, content])``: the elements of some parts.

    One task per group of workbooks; elements are handed on as they are found. Without ``content`` a workbook is read
    from its path, entry by entry. What cannot be opened gives one row with part ``error``.
    """
    held = "content" in files.columns

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "part", "entry", "seq", "xml"]
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"] if held else [None] * len(batch)):
                for row in _unzip_one(path, bytes(content) if held else None, parts):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", *(["content"] if held else [])).mapInPandas(unzip, PART_SCHEMA)


def stored_parts(files: DataFrame) -> DataFrame:
    """:func:`workbook_parts` of all parts, unzipped once and written to the shared folder by part.

    What reads one part does not touch the others, and an error in any part is known to all. A cell that points beyond
    the shared strings of its workbook is such an error.
    """
    target = scratch_path(files.sparkSession, "parts")
    workbook_parts(files, *ENTRIES).write.partitionBy("part").parquet(target)
    parts = files.sparkSession.read.schema(PART_SCHEMA).parquet(target)
    unresolved_strings(parts).write.mode("append").partitionBy("part").parquet(target)
    return files.sparkSession.read.schema(PART_SCHEMA).parquet(target)


def unresolved_strings(parts: DataFrame) -> DataFrame:
    """An error row for each workbook with a cell that points to no shared string: only rows with such cells are read."""
    pointing = stored_rows(parts.filter(F.col("xml").rlike(r"\st\s*=\s*[\"']s[\"']")))
    index = F.transform(F.filter("c", lambda c: (c["_t"] == SHARED) & c["v"].isNotNull()), lambda c: c["v"].try_cast("bigint"))
    # an index that is no number, or negative, counts as beyond every table
    beyond = F.lit(2**62).cast("bigint")
    last = F.array_max(F.transform(index, lambda i: F.when(i >= 0, i).otherwise(beyond)))
    asked = pointing.select("path", last.alias("last")).groupBy("path").agg(F.max("last").alias("last"))
    there = parts.filter(F.col("part") == "si").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    bad = asked.join(there, "path", "left").filter(F.col("last") >= F.coalesce("n", F.lit(0)))
    return bad.select("path", F.lit("error").alias("part"), F.lit(None).cast("string").alias("entry"),
                      F.lit(0).cast("bigint").alias("seq"), F.lit("a cell points beyond the shared strings").alias("xml"))


def read_workbooks(spark: SparkSession, paths: str | list[str] | DataFrame, recursive: bool = False) -> DataFrame:
    """``files(path)`` of the workbooks among the given files, or of a listing; they are opened by path."""
    listed = paths if isinstance(paths, DataFrame) else list_files(spark, paths, WORKBOOK_TYPES, recursive)
    wanted = listed.filter(F.col("extension").isin(*WORKBOOK_TYPES) & F.col("message").isNull()).select("path")
    return wanted.repartition(max(1, min(wanted.count(), 4 * spark.sparkContext.defaultParallelism)))


def workbook_sheets(parts: DataFrame) -> DataFrame:
    """``(path, entry, sheet, ordinal)``: sheets in order, joined with their part by relation id."""
    sheets = parts.filter(F.col("part") == "sheet").select(
        "path",
        F.col("seq").cast("int").alias("ordinal"),
        F.xpath_string("xml", F.lit("/*/@name")).alias("sheet"),
        F.regexp_extract("xml", r'\s[\w.-]+:id\s*=\s*"([^"]*)"', 1).alias("rid"),
    )
    target = F.xpath_string("xml", F.lit("/*/@Target"))
    rels = parts.filter(F.col("part") == "rel").select(
        "path",
        F.xpath_string("xml", F.lit("/*/@Id")).alias("rid"),
        F.when(target.startswith("/"), F.regexp_replace(target, r"\A/+", ""))
        .otherwise(F.concat(F.lit("xl/"), target)).alias("entry"),
    )
    return sheets.join(rels, ["path", "rid"]).select("path", "entry", "sheet", "ordinal")


def workbook_formats(parts: DataFrame) -> DataFrame:
    """``(path, s, format_id, format_code)``: number format of each style index."""
    formats = parts.filter(F.col("part") == "xf").select(
        "path",
        F.col("seq").cast("int").alias("s"),
        F.xpath_string("xml", F.lit("/*/@numFmtId")).try_cast("int").alias("format_id"),
    )
    codes = parts.filter(F.col("part") == "numFmt").select(
        "path",
        F.xpath_string("xml", F.lit("/*/@numFmtId")).try_cast("int").alias("format_id"),
        F.xpath_string("xml", F.lit("/*/@formatCode")).alias("format_code"),
    ).dropDuplicates(["path", "format_id"])
    return formats.join(codes, ["path", "format_id"], "left")


def sheet_styles(sheets: DataFrame, formats: DataFrame, format_code_check: bool = False) -> DataFrame:
    """Sheets with ``dated``, the style indexes of their workbook that show dates.

    A workbook has at most some ten thousand styles, and few of them are dates.
    """
    code = F.col("format_code") if format_code_check else None
    dated = formats.filter(is_date_format(F.col("format_id"), code)).groupBy("path").agg(
        F.collect_set("s").alias("dated")
    )
    return sheets.join(dated, "path", "left").withColumn(
        "dated", F.coalesce("dated", F.array().cast("array<int>"))
    )


def shared_strings(parts: DataFrame) -> DataFrame:
    """``(path, idx, shared)``: text of each shared string, all its runs joined."""
    return parts.filter(F.col("part") == "si").select(
        "path", F.col("seq").alias("idx"), F.xpath_string("xml", F.lit("/*")).alias("shared")
    )


def stored_rows(parts: DataFrame) -> DataFrame:
    """``(path, entry, row_seq, row, c)``: rows as they are stored, ``c`` the array of their cells."""
    rows = parts.filter(F.col("part") == "row")
    parsed = rows.select(
        "path", "entry", F.col("seq").alias("row_seq"), F.from_xml("xml", ROW_SCHEMA, XML_OPTIONS).alias("x")
    )
    return parsed.select(
        "path", "entry", "row_seq", F.coalesce("x._r", F.col("row_seq") + 1).alias("row"), F.col("x.c").alias("c")
    )


def stored_cells(rows: DataFrame) -> DataFrame:
    """One row per stored cell: ``pos, ref, s, t, v`` and the columns of its row. Rows without
    cells leave nothing."""
    kept = [c for c in rows.columns if c != "c"]
    return rows.select(*kept, F.posexplode("c").alias("pos", "c")).select(
        *kept, "pos", F.col("c._r").alias("ref"), F.col("c._s").alias("s"), F.col("c._t").alias("t"),
        F.col("c.v").alias("v"),
    )


# A shared string with more cells than this is joined from a small table instead of by a shuffle.
HOT_STRING = 1 << 16


def hot_strings(cells: DataFrame, strings: DataFrame, least: int | None = None) -> DataFrame:
    """The shared strings that more than ``least`` cells point to: at most all cells / ``least``.

    Counted in each task before the shuffle, which a very common string does not burden.
    """
    pointing = cells.filter(F.col("t") == SHARED).select("path", F.col("v").try_cast("bigint").alias("idx"))
    counted = pointing.groupBy("path", "idx").agg(F.count(F.lit(1)).alias("n"))
    common = counted.filter(F.col("n") > (HOT_STRING if least is None else least)).select("path", "idx")
    return materialize(strings.join(checked_broadcast(materialize(common)), ["path", "idx"]))


def with_shared(cells: DataFrame, strings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``cells`` with ``shared``, the string that each points to.

    Cells of ``hot`` strings find them in that table, which is broadcast if its size allows it. Cells that point to
    none, or to a hot one, get a key of their own spread over negative numbers, so that they do not meet in one task.
    """
    spread = -1 - (F.col("row_seq") % 1024)
    index = F.when(F.col("t") == SHARED, F.col("v").try_cast("bigint"))
    if hot is None:
        return cells.withColumn("idx", F.coalesce(index, spread)).join(strings, ["path", "idx"], "left")
    found = cells.withColumn("idx", index).join(
        checked_broadcast(hot.select("path", "idx", F.col("shared").alias("_hot"))), ["path", "idx"], "left")
    rest = found.withColumn("idx", F.when(F.col("_hot").isNull(), F.col("idx")))
    joined = rest.withColumn("idx", F.coalesce("idx", spread)).join(strings, ["path", "idx"], "left")
    return joined.withColumn("shared", F.coalesce("_hot", "shared")).drop("_hot")


def resolve_cells(cells: DataFrame, strings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Stored cells with the columns of :func:`sheet_styles`, resolved to kind and text; see :func:`with_shared`."""
    joined = with_shared(cells, strings, hot)
    dated = F.coalesce(F.array_contains("dated", F.col("s")), F.lit(False))
    numeric = F.col("t").isNull() | ~F.col("t").isin(SHARED, STRING, BOOLEAN)
    return (
        joined.withColumn("_dated", dated)
        .withColumn("_num", F.when(numeric, lenient_or_overflow(F.col("v"))))
        .withColumn("_num", finite(F.col("_num")))
        .withColumn("kind", stored_kind(F.col("t"), F.col("v"), F.col("_num"), F.col("_dated")))
        .withColumn("text", stored_text(F.col("kind"), F.col("t"), F.col("v"), F.col("shared"), F.col("_num")))
        .withColumn("num", F.when(F.col("kind").isin("number", "date"), F.col("_num")))
        .withColumn("dt", F.when(F.col("kind") == "date", serial_date(F.col("_num")).cast("timestamp_ntz")))
        .select(
            "path",
            "sheet",
            "ordinal",
            "row_seq",
            "row",
            "pos",
            F.when(F.col("ref").isNotNull() & (F.col("ref") != ""), ref_column(F.col("ref"))).alias("col"),
            "ref",
            "kind",
            "text",
            "num",
            "dt",
            F.coalesce("s", F.lit(0)).alias("style"),
        )
    )


def workbook_cells(
    files: DataFrame,
    worksheet_index: int | None = 0,
    format_code_check: bool = False,
    parts: DataFrame | None = None,
) -> DataFrame:
    """``cells`` of ``files(path, content)``: one sheet by position, or all with ``None``.

    The size of the sheets with their dated styles is measured: as a rule they are broadcast to the rows.
    Rows are joined whole, before their cells are spread out, and only then the shared strings: broadcast where they
    are small, else by a shuffle, but for the strings that very many cells point to. A workbook
    with an error in any part has no cells. ``parts`` are the :func:`stored_parts`, if they are there already.
    """
    parts = stored_parts(files) if parts is None else parts
    failed = parts.filter(F.col("part") == "error").select("path").distinct()
    sheets = workbook_sheets(parts).join(failed, "path", "left_anti")
    if worksheet_index is not None:
        sheets = sheets.filter(F.col("ordinal") == worksheet_index)
    styled = sheet_styles(sheets, workbook_formats(parts), format_code_check)
    if is_small(styled):
        styled = F.broadcast(styled)
    rows = stored_rows(parts).join(styled, ["path", "entry"])
    cells, strings = stored_cells(rows), shared_strings(parts)
    if is_small(strings):
        return resolve_cells(cells, F.broadcast(strings))
    return resolve_cells(cells, strings, hot_strings(cells, strings))


def read_workbook_cells(
    spark: SparkSession,
    paths: str | list[str],
    worksheet_index: int | None = 0,
    format_code_check: bool = False,
    recursive: bool = False,
) -> DataFrame:
    """``cells`` of workbook files; see :func:`workbook_cells`."""
    return workbook_cells(read_workbooks(spark, paths, recursive), worksheet_index, format_code_check)


def workbook_status(files: DataFrame, worksheet_index: int | None = 0, parts: DataFrame | None = None) -> DataFrame:
    """``(path, status, message)``: can all parts of the workbook be read, and has it the sheet asked for?"""
    parts = stored_parts(files) if parts is None else parts
    parts = parts.filter(F.col("part").isin("sheet", "error")).groupBy("path").agg(
        F.max(F.when(F.col("part") == "error", F.col("xml"))).alias("_error"),
        F.count_if(F.col("part") == "sheet").alias("_sheets"),
    )
    known = files.select("path").join(parts, "path", "left")
    sheets = F.coalesce("_sheets", F.lit(0))
    missing: Column = F.lit(False) if worksheet_index is None else sheets <= worksheet_index
    message = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(sheets == 0, "no worksheets")
        .when(missing, f"no worksheet {worksheet_index}")
    )
    return known.withColumn("message", message).select(
        "path", F.when(F.col("message").isNull(), "ok").otherwise("failed").alias("status"), "message"
    )
