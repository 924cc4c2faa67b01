"""Whole conversions: text files to typed cells and workbooks, workbooks to text, batches of both."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.charset import BOM, UTF8
from rowloom.functions.split import AUTO_SEPARATORS
from rowloom.functions.refs import output_path, path_base, path_extension, path_folder, safe_sheet_name
from rowloom.operators.cells import to_cells, with_profile, with_typed_fields
from rowloom.operators.densify import densify, render_lines
from rowloom.operators.profile import ANALYZE_LINES, PROFILE_COLUMNS, profile_files, profile_heads
from rowloom.rules import DEFAULT_RULES, Rules
from rowloom.session import checked_broadcast, materialize
from rowloom.sinks.files import write_files
from rowloom.sinks.naming import free_names
from rowloom.sinks.outputs import output_names, place_outputs, text_pieces
from rowloom.sinks.text import write_lines
from rowloom.sinks.workbooks import SHEET_ROWS, export_workbooks, workbook_pieces
from rowloom.sources.stores import qualified, reason, walk
from rowloom.sources.text_files import (
    TEXT_TYPES,
    WHOLE_FILE_BYTES,
    WORKBOOK_TYPES,
    block_table,
    explode_lines,
    list_files,
    number_lines,
    read_whole_files,
    stored_scan,
)
from rowloom.sources.workbooks import read_workbooks, stored_parts, workbook_cells, workbook_sheets, workbook_status


@dataclass(frozen=True)
class Options:
    """What a user can set; None means found out per file.

    With ``save_files`` a batch also leaves the file that each source becomes: a workbook for a text, a text per sheet
    for a workbook, in ``output_folder`` or next to the source, under the next free number where the name is taken and
    ``overwrite_files`` is not set.
    """

    encoding: str | None = None
    separator: str | None = None
    candidates: tuple[str, ...] = AUTO_SEPARATORS
    header: bool | None = None
    analyze_lines: int | None = ANALYZE_LINES  # None: all
    date_order: str = "dmy"
    rules: Rules = field(default_factory=lambda: DEFAULT_RULES)
    export_encoding: str = UTF8
    export_bom: bool = False
    export_separator: str = ";"
    quote_mode: int = 1
    worksheet_index: int = 0
    all_sheets: bool = False
    whole_file_bytes: int = WHOLE_FILE_BYTES
    recursive: bool = False
    save_files: bool = False
    output_folder: str | None = None
    overwrite_files: bool = False
    rows_per_workbook: int = SHEET_ROWS


# Characters of an output's name that are for reading: with the hash it stays below 255 bytes in any script.
READABLE = 50

SETTINGS = ("encoding", *PROFILE_COLUMNS)

# Tables of a batch. Fixed values of the isolation of failing files: groups tried before all are taken to fail alike.
TABLES = ("cells", "lines", "profile", "report")
HOPELESS = 8


@dataclass(frozen=True)
class TextSource:
    """Text files read and profiled: ``lines`` carries the settings of its source on each line.

    Files that could not be read have a row in ``failures(path, message)``, and neither profile nor lines.
    """

    profile: DataFrame
    lines: DataFrame
    failures: DataFrame


def read_text(spark: SparkSession, paths: str | list[str] | DataFrame, options: Options = Options(), stored: bool = False) -> TextSource:
    """Profile text files and read their lines; ``paths`` may be a listing.

    Small files: one pass, no shuffle, each file profiled in the row it is read in. Large files:
    one pass over the ranges for charset and line numbers, one for the heads, and then the
    lines, joined with both small tables by checked broadcast. With ``stored`` small files too are read only once,
    so that profile, lines and failures tell of the same bytes.
    """
    size, types = options.whole_file_bytes, TEXT_TYPES
    files = paths if isinstance(paths, DataFrame) else list_files(spark, paths, types, options.recursive)
    every = read_whole_files(spark, files, options.encoding, types, size, stored=stored)
    whole = every.filter("message is null").drop("message")
    head_of = F.col("lines") if options.analyze_lines is None else F.slice("lines", 1, options.analyze_lines)
    heads = whole.withColumn("_head", head_of).withColumn("_total", F.size("lines"))
    small = profile_heads(
        heads, "_head", "_total", options.separator, options.header, options.rules, options.candidates
    )
    profile = small.select("path", *SETTINGS)
    lines = explode_lines(small.select("path", "lines", "separator", "start_line", "overrides"))
    missing = files.filter("message is not null").select("path", "message")
    failures = missing.unionByName(every.filter("message is not null").select("path", "message"))

    scan = stored_scan(spark, files, types, size)
    blocks = materialize(block_table(scan, options.encoding))
    if blocks.isEmpty():
        return TextSource(profile, lines, failures)
    failures = failures.unionByName(blocks.filter("message is not null").select("path", "message").distinct())
    read = blocks.filter("message is null")
    totals = read.groupBy("path").agg(F.first("encoding").alias("encoding"), F.max("total_lines").alias("total_lines"))
    head = number_lines(scan, blocks, head=options.analyze_lines)
    large = materialize(
        profile_files(
            head, options.separator, options.header, options.analyze_lines, options.rules,
            totals=totals.select("path", "total_lines"), candidates=options.candidates,
        ).join(totals.drop("total_lines"), "path").select("path", *SETTINGS)
    )
    numbered = with_profile(number_lines(scan, blocks), large, measured=True)
    return TextSource(
        profile.unionByName(large),
        lines.unionByName(numbered.select("path", "line_no", "line", "separator", "start_line", "overrides")),
        failures,
    )


def text_to_cells(source: TextSource, options: Options = Options()) -> DataFrame:
    """Long ``cells`` of text sources. No shuffle."""
    return to_cells(source.lines, options.date_order)


def text_to_workbooks(source: TextSource, options: Options = Options(), rows_per_workbook: int = SHEET_ROWS) -> DataFrame:
    """``(path, chunk, content)``: one workbook per source, further ones where a sheet is full."""
    return export_workbooks(_workbook_rows(source, options), rows_per_workbook)


def _workbook_rows(source: TextSource, options: Options) -> DataFrame:
    kept = source.lines.filter(F.col("line_no") >= F.col("start_line"))
    return with_typed_fields(kept, options.date_order).select(
        "path", (F.col("line_no") - F.greatest("start_line", F.lit(1)) + 1).alias("row"), "cells"
    )


def workbooks_to_lines(files: DataFrame, options: Options = Options(), parts: DataFrame | None = None) -> DataFrame:
    """``(path, sheet, row, line)`` of ``files(path, content)``: the sheets asked for as text."""
    index = None if options.all_sheets else options.worksheet_index
    cells = workbook_cells(files, index, parts=parts)
    rows = densify(cells, ("path", "sheet", "ordinal", "row_seq"))
    return render_lines(rows, options.export_separator, options.quote_mode).select(
        "path", "sheet", F.col("ordinal"), (F.col("row_seq") + 1).alias("row"), "line"
    )


def sheet_output(path: Column, sheet: Column, ordinal: Column) -> Column:
    """Folder name for one sheet of one workbook.

    The start of its names is there to be read; the hash of path and place of the sheet tells outputs apart.
    """
    name = F.concat_ws("_", path_base(path), safe_sheet_name(sheet))
    return F.concat_ws("-", F.left(name, F.lit(READABLE)), F.md5(F.concat_ws("/", path, ordinal.cast("string"))))


def batch_report(report: DataFrame) -> DataFrame:
    """Files per status of a report."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def convert_batch(
    spark: SparkSession,
    paths: str | list[str] | DataFrame,
    target: str,
    options: Options = Options(),
    batch_id: int = 0,
    overwrite: bool = False,
) -> DataFrame:
    """Convert a set of files: text to typed cells, workbooks to delimited text; returns the report.

    Leaves ``cells``, ``lines``, ``profile`` and ``report`` below ``target``, each as the partition
    ``batch_id`` of a table, so that a repeated batch replaces its own output and nothing else. ``options.save_files`` also
    leaves the converted files themselves; a repeated batch gives them the names it gave them before.

    Every wanted file has a row in the report: hidden, empty, gone and unreadable ones too. Where the conversion as a
    whole fails, the files are halved until the ones that make it fail stand alone; these are reported as failed, and
    the others are converted.
    """
    root = target.rstrip("/").replace("%", "%%")
    at = f"{root}/%s/batch_id={batch_id}"
    there = [name for name in TABLES if _exists(spark, at % name)]
    if there and not overwrite:
        raise FileExistsError(at % there[0])
    for name in there:
        _delete(spark, at % name)
    files = paths if isinstance(paths, DataFrame) else list_files(spark, paths, recursive=options.recursive)
    files = materialize(files)
    groups, depth, done = [files], 0, False
    while groups:
        again = []
        for group in groups:
            staged = _attempt(target)
            try:
                _convert(spark, group, staged, options, at, files)
            except Exception as problem:  # whatever a file brings on
                _delete(spark, staged)
                two = group.limit(2).collect()
                if len(two) > 1:
                    again.append((group, problem))
                    continue
                staged = _attempt(target)
                _report(group.select("path", F.lit(reason(problem)[:2000]).alias("message")), staged)
            else:
                done = True
            _publish(spark, staged, at)
            _delete(spark, staged)
        if len(again) >= HOPELESS and not done:
            raise again[0][1]  # nothing could be converted: it is not a file that makes this fail
        # one more bit of the hash of its path tells where a file goes; different paths part in the end
        halves = [group.filter(F.expr(f"getbit(xxhash64(path), {depth}) = {bit}")) for group, _ in again for bit in (0, 1)]
        groups = [half for half in halves if not half.isEmpty()]
        depth += 1
    return spark.read.parquet(at % "report")


def _attempt(target: str) -> str:
    """A folder for the tables of one attempt, in the file system they go to; its name hides it from readers."""
    return f"{target.rstrip('/')}/_attempts/{uuid.uuid4().hex}"


def _convert(spark: SparkSession, files: DataFrame, staged: str, options: Options, at: str, inputs: DataFrame) -> None:
    """Convert the files of a listing to the tables below ``staged``, the report last; ``at`` is where tables go to."""
    gone = F.col("message").isNotNull()
    text = files.filter(~gone & F.col("extension").isin(*TEXT_TYPES))
    books = files.filter(~gone & F.col("extension").isin(*WORKBOOK_TYPES))
    none = F.lit(None).cast("string")
    reports = [files.filter(gone).select("path", "message", none.alias("output"))]
    wanted, pieces = [], []
    if not text.isEmpty():
        source = read_text(spark, text, options, stored=True)
        source.profile.write.parquet(f"{staged}/profile")
        text_to_cells(source, options).write.parquet(f"{staged}/cells")
        read = text.select("path").join(source.failures.groupBy("path").agg(F.first("message").alias("message")), "path", "left")
        reports.append(read.select("path", "message", F.lit(at % "cells").alias("output")))
        if options.save_files:
            every = spark.read.parquet(f"{staged}/profile").select("path")
            made = workbook_pieces(_workbook_rows(source, options), every, options.rows_per_workbook)
            chunk = F.when(F.col("chunk") > 0, F.concat(F.lit("-"), (F.col("chunk") + 1).cast("string"))).otherwise("")
            wanted.append(made.select("path", F.concat_ws("#", "path", "chunk").alias("key"),
                                      F.concat(path_base(F.col("path")), chunk).alias("base"), F.lit(".xlsx").alias("extension")))
            pieces.append(made.select(F.concat_ws("#", "path", "chunk").alias("key"), F.lit(0).cast("bigint").alias("first"), "uri", "bytes"))
    if not books.isEmpty():
        opened = read_workbooks(spark, books)
        parts = stored_parts(opened)
        index = None if options.all_sheets else options.worksheet_index
        lines = workbooks_to_lines(opened, options, parts).withColumn(
            "output", sheet_output(F.col("path"), F.col("sheet"), F.col("ordinal")))
        status = materialize(books.select("path").join(workbook_status(opened, index, parts), "path", "left"))
        if options.save_files:
            stored = materialize(lines)
            keyed = stored.select(F.concat_ws("#", "path", "ordinal").alias("key"), "row", "line")
            pieces.append(text_pieces(keyed, options.export_encoding))
            sheets = workbook_sheets(parts).join(status.filter("status = 'ok'").select("path"), "path", "left_semi")
            sheet = F.concat(F.lit("_"), safe_sheet_name(F.col("sheet"))) if options.all_sheets else F.lit("")
            chosen = sheets if options.all_sheets else sheets.filter(F.col("ordinal") == index)
            wanted.append(chosen.select("path", F.concat_ws("#", "path", "ordinal").alias("key"),
                                        F.concat(path_base(F.col("path")), sheet).alias("base"), F.lit(".csv").alias("extension")))
            lines = stored
        write_lines(lines, f"{staged}/lines", ["row"], ["output"], options.export_encoding, options.export_bom)
        reports.append(status.select("path", "message", F.lit(at % "lines").alias("output")))
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    if not wanted:
        return _report(report, staged)
    placed = _place(spark, wanted, pieces, options, at % "names", inputs)
    _report(report, staged, placed)


def _place(spark: SparkSession, wanted: list[DataFrame], pieces: list[DataFrame], options: Options, names: str,
           inputs: DataFrame) -> DataFrame:
    """Name the outputs, write the names down, and put the files there: ``(path, file, message)`` of each."""
    folder = path_folder(F.col("path"))
    if options.output_folder is not None:
        folder = F.lit(qualified(spark, options.output_folder).rstrip("/") + "/")
    all_wanted, all_pieces = wanted[0], pieces[0]
    for more in wanted[1:]:
        all_wanted = all_wanted.unionByName(more)
    for more in pieces[1:]:
        all_pieces = all_pieces.unionByName(more)
    all_wanted = materialize(all_wanted.withColumn("folder", folder))
    known = spark.read.parquet(names).select("key", "file") if _exists(spark, names) else None
    named = materialize(output_names(all_wanted, options.overwrite_files, inputs.select("path"), known))
    # what the batch named before is its own file, which it may replace
    own = F.lit(False) if known is None else F.col("_own").isNotNull()
    owned = named if known is None else named.join(known.select("key", F.lit(True).alias("_own")), "key", "left")
    named = materialize(owned.select("key", "file", own.alias("own")))
    named.filter("not own").select("key", "file").write.mode("append").parquet(names)
    # a mark stands before text, not before a workbook
    texts = F.lower("file").endswith(".csv")
    mark = BOM.encode() if options.export_bom and options.export_encoding == UTF8 else b""
    replace = options.overwrite_files
    placed = place_outputs(named.filter(texts), all_pieces, replace, mark).unionByName(
        place_outputs(named.filter(~texts), all_pieces, replace))
    return materialize(placed.join(all_wanted.select("key", "path"), "key").select("path", "file", "message"))


def _report(report: DataFrame, staged: str, placed: DataFrame | None = None) -> None:
    """``(path, status, message, output, files)``: the table a file went to, and the files it became."""
    if "output" not in report.columns:
        report = report.withColumn("output", F.lit(None).cast("string"))
    if placed is None:
        report = report.withColumn("files", F.array().cast("array<string>"))
    else:
        made = placed.groupBy("path").agg(
            F.sort_array(F.collect_list(F.when(F.col("message").isNull(), F.col("file")))).alias("files"),
            F.max("message").alias("_unplaced"))
        report = report.join(made, "path", "left").withColumn("message", F.coalesce("message", "_unplaced")).withColumn(
            "files", F.coalesce("files", F.array().cast("array<string>")))
    done = F.when(F.col("message").isNull(), "ok").otherwise("failed")
    report.select(
        "path", done.alias("status"), "message", F.when(F.col("message").isNull(), F.col("output")).alias("output"), "files"
    ).write.parquet(f"{staged}/report")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, system = _path(spark, path)
    system.delete(at, True)


def _publish(spark: SparkSession, staged: str, target: str) -> None:
    """Move the tables of a finished attempt into their partitions, the report last. Part files have names of their own."""
    for name in TABLES:
        source, system = _path(spark, f"{staged}/{name}")
        if not system.exists(source):
            continue
        at, there = _path(spark, target % name)
        there.mkdirs(at)
        for entry in system.listStatus(source):
            _merge(spark, there, entry.getPath(), at)


def _merge(spark: SparkSession, system, entry, folder) -> None:
    """Move a file, or the files of a folder, into ``folder``; folders that are there stay."""
    to = spark._jvm.org.apache.hadoop.fs.Path(folder, entry.getName())
    if system.exists(to) and system.getFileStatus(entry).isDirectory():
        for inner in system.listStatus(entry):
            _merge(spark, system, inner.getPath(), to)
    elif not system.exists(to) and not system.rename(entry, to):
        raise OSError(f"{entry} could not be moved to {to}")


def save_workbooks(spark: SparkSession, books: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write ``books(path, chunk, content)`` as files in ``folder``; returns the report.

    A name that is taken gets the next free number unless ``overwrite`` is set.
    """
    books = materialize(books)
    target = qualified(spark, folder)
    chunk = F.when(F.col("chunk") > 0, F.concat(F.lit("-"), (F.col("chunk") + 1).cast("string"))).otherwise("")
    base = F.concat(path_base(F.col("path")), chunk)
    wanted = books.select("path", "chunk", base.alias("base"), F.lit(".xlsx").alias("extension"))
    if overwrite:
        named = wanted.withColumn("name", F.concat("base", "extension"))
    else:
        named = free_names(wanted.withColumn("key", F.concat_ws("#", "path", "chunk")), _listing(spark, target), "key")
    plan = checked_broadcast(materialize(named.select("path", "chunk", "name")))
    return write_files(books.join(plan, ["path", "chunk"]).select("name", "content"), target, overwrite)


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(name)`` of all files in a folder, also empty ones and those Spark does not read; none if it is not there yet."""
    listed = walk(spark.createDataFrame([(folder, [])], "path string, todo array<string>"))
    return listed.filter("message is null").select(F.regexp_extract("path", r"([^/\\]*)\z", 1).alias("name"))


def target_paths(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Where each file of a listing would be written: the other format, same base name."""
    return files.withColumn("target", output_path(F.col("path"), None if folder is None else F.lit(folder))).withColumn(
        "extension", path_extension(F.col("target"))
    )
