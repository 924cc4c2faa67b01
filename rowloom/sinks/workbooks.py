"""Typed cells as workbooks: one per source, further ones where a sheet is full."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.cells import FORMAT_OF_STYLE, stored_value
from rowloom.functions.numbers import number_text
from rowloom.functions.refs import cell_ref
from rowloom.session import scratch_path
from rowloom.sinks.outputs import new_piece

# Rows a sheet can hold, and the name of the sheet.
SHEET_ROWS = 1048576
SHEET_NAME = "Tabelle1"

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEET_ENTRY = "xl/worksheets/sheet1.xml"


def _styles_xml() -> str:
    own = {i: code for i, code in FORMAT_OF_STYLE.values() if i >= 164}
    formats = "".join(f'<numFmt numFmtId="{i}" formatCode={quoteattr(code)}/>' for i, code in own.items())
    cells = "".join(
        f'<xf numFmtId="{i}" fontId="0" fillId="0" borderId="0"{" applyNumberFormat=" + quoteattr("1") if i else ""}/>'
        for i, _ in (FORMAT_OF_STYLE[s] for s in sorted(FORMAT_OF_STYLE))
    )
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="{len(own)}">{formats}</numFmts>'
        '<fonts count="1"><font/></fonts>'
        '<fills count="2"><fill><patternFill patternType="none"/></fill>'
        '<fill><patternFill patternType="gray125"/></fill></fills>'
        '<borders count="1"><border/></borders>'
        f'<cellXfs count="{len(FORMAT_OF_STYLE)}">{cells}</cellXfs></styleSheet>'
    )


def _fixed_parts(sheet: str) -> dict[str, str]:
    """Parts that are the same in every workbook but for the name of the sheet."""
    return {
        "[Content_Types].xml": (
            f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>'
            f'<Override PartName="/{_SHEET_ENTRY}" ContentType="{_TYPES}.worksheet+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>'
        ),
        "_rels/.rels": (
            f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
            f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
        ),
        "xl/workbook.xml": (
            f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>'
            f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>'
        ),
        "xl/_rels/workbook.xml.rels": (
            f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
            f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>'
        ),
        "xl/styles.xml": _styles_xml(),
    }


def xml_text(text: Column) -> Column:
    """Escaped for XML; characters XML cannot hold become the replacement character."""
    valid = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "�")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        valid = F.replace(valid, F.lit(char), F.lit(entity))
    return valid


def cell_xml(cell: Column, col: Column, row: Column) -> Column:
    """One stored cell of a typed cell struct."""
    kind = cell["kind"]
    value = stored_value(kind, cell["text"], cell["num"], cell["dt"], number_text(cell["num"]))
    string = F.when(kind.isin("integer", "decimal", "date"), "").otherwise(' t="str"')
    return F.concat(
        F.lit('<c r="'), cell_ref(col, row), F.lit('" s="'), cell["style"].cast("string"), F.lit('"'), string,
        F.lit("><v>"), xml_text(value), F.lit("</v></c>"),
    )


def row_xml(cells: Column, row: Column) -> Column:
    """One stored row of an array of typed cells."""
    body = F.array_join(F.transform(cells, lambda c, i: cell_xml(c, i, row)), "")
    return F.concat(F.lit('<row r="'), row.cast("string"), F.lit('">'), body, F.lit("</row>"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """``(path, row, cells)`` of long ``cells``: one shuffle on the row key."""
    packed = F.array_sort(F.collect_list(F.struct("col", "kind", "text", "num", "dt", "style")))
    return cells.groupBy("path", "row").agg(packed.alias("cells"))


def _stored(rows: DataFrame, rows_per_workbook: int, every: DataFrame | None = None) -> DataFrame:
    """``(path, chunk, xml)`` of rows, dealt by workbook and in order; a null ``xml`` for a workbook that may have none."""
    limit = min(rows_per_workbook, SHEET_ROWS)
    chunk = F.floor((F.col("row") - 1) / F.lit(limit)).cast("int")
    placed = rows.withColumn("chunk", chunk).withColumn("_at", F.col("row") - F.col("chunk").cast("bigint") * limit)
    stored = placed.select("path", "chunk", "_at", row_xml(F.col("cells"), F.col("_at")).alias("xml"))
    if every is not None:
        none = F.lit(None).cast("string")
        stored = stored.unionByName(every.select("path", F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("_at"), none.alias("xml")))
    return stored.repartition("path", "chunk").sortWithinPartitions("path", "chunk", "_at").select("path", "chunk", "xml")


class _Stream:
    """A stream that is only written, so that a container goes to it piece by piece."""

    def __init__(self, out: Any) -> None:
        self.out, self.size = out, 0

    def write(self, data: bytes) -> int:
        data = bytes(data)
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def _packed(batches: Iterator[pd.DataFrame], parts: dict[str, str], start: Callable[[], Any]) -> Iterator[tuple[str, int, Any]]:
    """Rows that come workbook by workbook, written as containers to the streams that ``start`` gives."""
    key = box = entry = stream = None

    def finish() -> tuple[str, int, Any]:
        entry.write(b"</sheetData></worksheet>")
        entry.close()
        box.close()
        return key[0], key[1], stream

    for batch in batches:
        for (path, number), group in batch.groupby(["path", "chunk"], sort=False):
            if (path, number) != key:
                if key is not None:
                    yield finish()
                key, stream = (path, number), start()
                box = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                for name, xml in parts.items():
                    box.writestr(zipfile.ZipInfo(name), xml, zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(_SHEET_ENTRY)
                info.compress_type = zipfile.ZIP_DEFLATED
                entry = box.open(info, "w", force_zip64=True)
                entry.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            entry.write("".join(x for x in group["xml"] if x is not None).encode())
    if key is not None:
        yield finish()


def export_workbooks(rows: DataFrame, rows_per_workbook: int = SHEET_ROWS, sheet: str = SHEET_NAME) -> DataFrame:
    """``(path, chunk, content)`` of ``rows(path, row, cells)``, ``cells`` in column order.

    A source with more rows than a sheet can hold goes on in a further chunk. One shuffle by
    source and chunk; rows stream into the container in order, so a task holds the
    compressed workbook only.
    """
    parts = _fixed_parts(sheet)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, number, buffer in _packed(batches, parts, io.BytesIO):
            yield pd.DataFrame({"path": [path], "chunk": [number], "content": [buffer.getvalue()]})

    return _stored(rows, rows_per_workbook).mapInPandas(pack, "path string, chunk int, content binary")


def workbook_pieces(rows: DataFrame, every: DataFrame, rows_per_workbook: int = SHEET_ROWS, sheet: str = SHEET_NAME) -> DataFrame:
    """:func:`export_workbooks` as files: ``(path, chunk, uri, bytes)``, a table in the shared folder.

    Each workbook streams into its file; a task holds none. ``every(path)`` names all sources: one without rows is an empty
    workbook.
    """
    parts, folder = _fixed_parts(sheet), scratch_path(rows.sparkSession, "workbooks")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uris: list[str] = []

        def start() -> _Stream:
            uri, out = new_piece(folder)
            uris.append(uri)
            return _Stream(out)

        for (path, number, stream) in _packed(batches, parts, start):
            stream.out.close()
            yield pd.DataFrame({"path": [path], "chunk": [number], "uri": [uris.pop(0)], "bytes": [stream.size]})

    target = scratch_path(rows.sparkSession, "pieces")
    schema = "path string, chunk int, uri string, bytes bigint"
    _stored(rows, rows_per_workbook, every).mapInPandas(pack, schema).write.parquet(target)
    return rows.sparkSession.read.schema(schema).parquet(target)
