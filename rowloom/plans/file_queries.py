"""Registered queries that go through files: tables are written as text below the shared folder
and read back as a user's files would be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.charset import BOM, CP1252, LATIN1, LATIN9, UTF8, UTF16BE, UTF16LE, encode_raw
from rowloom.functions.refs import path_folder
from rowloom.functions.split import line_array
from rowloom.operators.cells import column_types
from rowloom.plans.convert import (
    Options, batch_report, convert_batch, read_text, save_workbooks, text_to_cells,
)
from rowloom.plans.queries import CHECKSUM_MODULUS, TYPE_REPORT, checksum, customer_rows, spread, table
from rowloom.session import materialize, scratch_folder, scratch_path
from rowloom.sinks.outputs import place_outputs, text_pieces
from rowloom.sinks.text import write_lines
from rowloom.sinks.workbooks import export_workbooks
from rowloom.sources.tables import print_line, table_lines
from rowloom.sources.text_files import explode_lines, list_files, read_lines
from rowloom.sources.workbooks import read_workbook_cells
from rowloom.streaming.watch import watch_folder


def _folder_name(path: F.Column) -> F.Column:
    """Name of the folder a file lies in, as in ``.../charset=UTF-8/part-0.txt``."""
    return F.regexp_extract(path_folder(path), r"=([^/=]*)/\z", 1)


def drop_files(lines: DataFrame, folder: str, extension: str, charset: str = UTF8, mark: bytes = b"",
               empty: tuple[str, ...] = ()) -> None:
    """A file of the given lines per ``key`` of ``lines(key, row, line)`` in ``folder``, and some empty ones.

    The pieces go when the files are there. The report is written, as a checkpoint would place every file twice.
    """
    spark = lines.sparkSession
    with scratch_folder(spark, "dropped"):
        pieces = text_pieces(lines, charset)
        file = F.concat(F.lit(f"{folder}/"), F.col("key"), F.lit(extension))
        names = pieces.select("key").distinct().select("key", file.alias("file"), F.lit(False).alias("own"))
        if empty:
            nothing = spark.createDataFrame([(n, f"{folder}/{n}", False) for n in empty], names.schema)
            names = names.unionByName(nothing)
        report = scratch_path(spark, "report")
        place_outputs(names, pieces, overwrite=True, mark=mark).write.parquet(report)
        failed = spark.read.parquet(report).filter("status != 'ok'").first()
    if failed is not None:
        raise OSError(failed["message"])


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, cut once and stored."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), line_array(F.col("text")).alias("lines")
    )
    target = scratch_path(spark, "document_lines")
    lines = explode_lines(docs)
    lines.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(lines.schema).parquet(target)


def charset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document lines written in six charsets and read back, the charset given per folder or found.

    The files of a charset, and all made to read them, go when they have been read. Files of two bytes a character, which
    are put together from pieces as large, do so one by one.
    """
    read = []

    def counted(charset: str, target: str, given: str | None, whole: int) -> DataFrame:
        back = read_lines(spark, target, given, whole_file_bytes=whole).select(F.lit(charset).alias("charset"), "line")
        return materialize(back.groupBy("charset").agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.length("line")).alias("chars"),
            checksum(F.col("line")).alias("checksum"),
        ))

    with scratch_folder(spark, "charsets"):
        lines = _document_lines(spark, sf_dir)
        for charset, given in ((UTF8, None), (CP1252, None), (LATIN1, LATIN1), (LATIN9, LATIN9)):
            with scratch_folder(spark, "charset"):
                target = scratch_path(spark, "charset")
                lines.select(encode_raw(F.col("line"), charset).alias("value")).write.text(target)
                # Large files and small ones take different ways; a low bound sends these the splittable way.
                read.append(counted(charset, target, given, -1 if charset == CP1252 else 1 << 24))
        part = F.pmod("doc_id", F.lit(4))
        for charset, whole in ((UTF16LE, 1 << 24), (UTF16BE, -1)):
            for n in range(4):
                with scratch_folder(spark, "charset"):
                    target = scratch_path(spark, "charset")
                    keyed = lines.filter(part == n).select(F.concat(F.lit("part"), part.cast("string")).alias("key"),
                                                           (F.col("doc_id") * (1 << 32) + F.col("line_no")).alias("row"), "line")
                    drop_files(keyed, target, ".txt", charset, BOM.encode(charset))
                    read.append(counted(charset, target, None, whole))
    # Sums of at most four checksums fit a whole number.
    return reduce(DataFrame.unionByName, read).groupBy("charset").agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.sum("chars").alias("chars"),
        (F.sum("checksum") % F.lit(CHECKSUM_MODULUS)).alias("checksum"),
    )


def line_file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written in order as one large file per type, split into blocks, and numbered again."""
    events = table(spark, sf_dir, "events")
    columns = ["event_id", "user_id", "value"]
    target = scratch_path(spark, "numbers")
    lines = table_lines(events, F.col("event_type"), F.col("event_id"), columns, ";")
    # Few lines per type here; the blocks are what a cluster would get from large files.
    write_lines(lines.withColumnRenamed("path", "kind"), target, ["line_no"], ["kind"])
    read = read_lines(spark, target, whole_file_bytes=-1, recursive=True)
    event = F.split("line", ";", 3)
    return read.groupBy(_folder_name(F.col("path")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(event[0].cast("bigint")).alias("ids"),
        F.countDistinct("path", "line_no").alias("numbers"),
        checksum(F.col("line")).alias("checksum"),
    )


def _write_by(spark: SparkSession, df: DataFrame, by: str, columns: list[str], sep: str, name: str) -> str:
    """One folder of text files per value of ``by``; each task writes its own file there."""
    target = scratch_path(spark, name)
    lines = df.select(F.col(by).alias("kind"), print_line(df, columns, sep).alias("value"))
    lines.write.partitionBy("kind").text(target)
    return target


def file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as text files per market segment, listed and profiled as files."""
    customer = table(spark, sf_dir, "customer")
    target = _write_by(spark, customer, "c_mktsegment", customer.columns, "|", "segments")
    source = read_text(spark, target, Options(recursive=True))
    listed = list_files(spark, target, recursive=True).select("path", "extension")
    segment = _folder_name(F.col("path")).alias("segment")
    same = ["extension", "encoding", "separator", "separator_probability", "start_line", "field_count"]
    return source.profile.join(listed, "path").groupBy(segment, *same).agg(
        F.sum("total_lines").alias("total_lines"), F.bool_and("is_field_count_equal").alias("is_field_count_equal")
    )


def file_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text files per status, read, typed, and rolled up per status and column."""
    orders = table(spark, sf_dir, "orders")
    target = _write_by(spark, orders, "o_orderstatus", orders.columns, ";", "orders")
    source = read_text(spark, target, Options(recursive=True, header=False, whole_file_bytes=1 << 16))
    cells = text_to_cells(source).withColumn("path", _folder_name(F.col("path")))
    return column_types(cells).select(*TYPE_REPORT)


def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dropped in a watched folder as text files and converted micro-batch by micro-batch."""
    events = table(spark, sf_dir, "events")
    drop = scratch_path(spark, "drop")
    target, checkpoint = scratch_path(spark, "converted"), scratch_path(spark, "watch")
    lines = events.select(print_line(events, ["event_id", "event_type", "value", "ts"], ";").alias("value"))
    options = Options(header=False)
    for part, mode in ((lines, "append"), (lines.filter(F.col("value").contains("click")), "append")):
        part.write.mode(mode).text(drop)
        query = watch_folder(spark, drop, target, checkpoint, options, available_now=True)
        query.awaitTermination()
    cells = spark.read.option("basePath", f"{target}/cells").parquet(f"{target}/cells")
    return column_types(cells, ("col",)).select(*[c for c in TYPE_REPORT if c != "path"])


def _hard_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A hidden file with the nations, an empty one, and a workbook that is none."""
    nation = table(spark, sf_dir, "nation")
    lines = nation.select(F.lit("_nations").alias("key"), F.col("n_nationkey").alias("row"),
                          print_line(nation, ["n_nationkey", "n_name", "n_regionkey"], ";").alias("line"))
    drop_files(lines, folder, ".csv", empty=(".empty.csv", "broken.xlsx"))


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dropped as files, with hidden, empty and broken ones: each status of the report, every file converted once."""
    pages = table(spark, sf_dir, "pages")
    drop = scratch_path(spark, "drop")
    target, checkpoint = scratch_path(spark, "converted"), scratch_path(spark, "watch")
    numbers = pages.select(print_line(pages, ["page_id", "url"], ";").alias("value"))
    spread(numbers).write.text(drop)
    _hard_files(spark, sf_dir, drop)
    for _ in range(2):  # the second start finds nothing new
        watch_folder(spark, drop, target, checkpoint, Options(), available_now=True).awaitTermination()
    report = spark.read.option("basePath", f"{target}/report").parquet(f"{target}/report")
    profile = spark.read.option("basePath", f"{target}/profile").parquet(f"{target}/profile")
    once = report.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.max("status").alias("status"))
    counted = once.join(profile.select("path", "total_lines"), "path", "left")
    hard = F.col("path").rlike(r"/(_nations\.csv|\.empty\.csv|broken\.xlsx)$")
    return counted.groupBy("status", "times").agg(
        F.coalesce(F.sum("total_lines"), F.lit(0)).alias("lines"), F.count_if(hard).alias("hard_files"))


def batch_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of suppliers as text and customers as one workbook per nation, with hidden, empty, broken and missing
    files, converted in one batch: tables, the files that the sources become, and the failures."""
    suppliers = table(spark, sf_dir, "supplier")
    inbox, target, folder = (scratch_path(spark, n) for n in ("inbox", "converted", "files"))
    suppliers.select(print_line(suppliers, suppliers.columns, "\t").alias("value")).write.text(inbox)
    books = materialize(export_workbooks(customer_rows(spark, sf_dir)))
    saved = save_workbooks(spark, books, inbox)
    saved.write.parquet(scratch_path(spark, "saved"))
    _hard_files(spark, sf_dir, inbox)
    options = Options(header=False, all_sheets=True, save_files=True, output_folder=folder)
    report = convert_batch(spark, [inbox, f"{inbox}/gone.csv"], target, options)
    hidden = F.col("path").endswith("_nations.csv")
    cells = spark.read.option("basePath", f"{target}/cells").parquet(f"{target}/cells")

    def items(df: DataFrame, name: str, sum_: F.Column) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("items"), sum_.alias("checksum")).select(F.lit(name).alias("output"), "items", "checksum")

    hundredths = F.sum(F.round(F.col("num") * 100).cast("bigint"))
    sheets = read_workbook_cells(spark, f"{folder}/*.xlsx")
    results = items(cells.filter(~hidden), "cells", checksum(F.col("text")))
    for more in (
        items(cells.filter(hidden), "hidden cells", checksum(F.col("text"))),
        items(spark.read.text(f"{target}/lines", lineSep="\r\n"), "lines", checksum(F.col("value"))),
        items(read_lines(spark, f"{folder}/*.csv"), "lines of files", checksum(F.col("line"))),
        items(sheets, "cells of files", F.coalesce(hundredths, F.lit(0).cast("bigint"))),
    ):
        results = results.unionByName(more)
    failed = batch_report(report).filter(F.col("status") == "failed").select(F.lit("failed").alias("output"),
        F.col("files").alias("items"), F.lit(0).cast("bigint").alias("checksum"))
    return results.unionByName(failed)


FILE_QUERIES = {
    f.__name__: f
    for f in (charset_files, line_file_numbers, file_profiles, file_cells, file_stream, stream_report, batch_conversion)
}
