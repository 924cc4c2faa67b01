"""Delimited text files: listing, charset, exact line numbers.

Small files are read whole, one row per file, so that profile and lines need no shuffle.
Large files are read as lines of byte ranges, once: a first pass reduces each range to one row (its
number of lines, whether it is valid UTF-8), a running total over these gives the number of
the first line of each range. Every wanted file that cannot be read has a row with its reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions import charset as cs
from rowloom.functions.split import line_array
from rowloom.session import checked_broadcast, materialize, scratch_path
from rowloom.sources.raw_files import line_ranges, whole_files
from rowloom.sources.stores import every_file

# File types converted.
TEXT_TYPES = (".csv", ".txt", ".log")
WORKBOOK_TYPES = (".xlsx",)

# Files up to this size are read as one row.
WHOLE_FILE_BYTES = 16 * 1024 * 1024


def literal_path(path: str) -> str:
    """A path to read that means itself, also where it holds pattern characters."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def list_files(spark: SparkSession, paths: str | list[str], types: tuple[str, ...] = TEXT_TYPES + WORKBOOK_TYPES,
               recursive: bool = False) -> DataFrame:
    """``files(path, extension, length, modified, message)`` of the given types, in any letter case.

    Hidden and empty files count too. A path that is not there or cannot be listed is a row with a message.
    """
    listed = every_file(spark, paths, recursive)
    return listed.filter(F.col("extension").isin(*types) | F.col("message").isNotNull())


def detected_encoding(mark: Column, valid_utf8: Column, given: str | None) -> Column:
    """What a byte order mark says, else the given charset, else UTF-8 if the bytes are valid UTF-8, else the fallback."""
    if given is not None and given not in cs.CHARSETS:
        raise ValueError(f"charset is one of {', '.join(cs.CHARSETS)}")
    found = F.when(valid_utf8, cs.UTF8).otherwise(cs.FALLBACK) if given is None else F.lit(given)
    return F.coalesce(mark, found)


def _files(spark: SparkSession, paths: str | list[str] | DataFrame, types: tuple[str, ...], recursive: bool) -> DataFrame:
    """The readable files of a listing, or of what is at some paths."""
    listed = paths if isinstance(paths, DataFrame) else list_files(spark, paths, types, recursive)
    return listed.filter(F.col("extension").isin(*types) & F.col("message").isNull())


def read_whole_files(
    spark: SparkSession,
    paths: str | list[str] | DataFrame,
    encoding: str | None = None,
    types: tuple[str, ...] = TEXT_TYPES,
    max_bytes: int = WHOLE_FILE_BYTES,
    recursive: bool = False,
    stored: bool = False,
) -> DataFrame:
    """``(path, encoding, lines array<string>, message)`` of the files up to ``max_bytes``; ``paths`` may be a listing.

    No shuffle but that of the listing. With ``stored`` the files are read once and kept in the shared folder.
    """
    files = _files(spark, paths, types, recursive).filter((F.col("length") <= max_bytes) | (F.col("length") == 0))
    raw = whole_files(files)
    if stored:
        target = scratch_path(spark, "files")
        raw.write.parquet(target)
        raw = spark.read.schema(raw.schema).parquet(target)
    text = F.col("raw").cast("string")
    decoded = raw.withColumn("_raw", text).withColumn(
        "encoding", detected_encoding(F.col("mark"), F.is_valid_utf8("_raw"), encoding)
    ).withColumn("_text", cs.decode_raw(F.col("_raw"), F.col("encoding")))
    return decoded.select("path", "encoding", line_array(F.col("_text")).alias("lines"), "message")


def explode_lines(whole: DataFrame) -> DataFrame:
    """Numbered lines of rows with an array ``lines``; all other columns stay. No shuffle.

    The outer form keeps Spark from filtering on the array first, which would decode and cut
    every text twice.
    """
    kept = [c for c in whole.columns if c != "lines"]
    exploded = whole.select(*kept, F.posexplode_outer("lines").alias("_pos", "line"))
    return exploded.filter(F.col("_pos").isNotNull()).select(
        kept[0], (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line", *kept[1:]
    )


def stored_scan(
    spark: SparkSession,
    paths: str | list[str] | DataFrame,
    types: tuple[str, ...] = TEXT_TYPES,
    above_bytes: int = -1,
    recursive: bool = False,
) -> DataFrame:
    """``(path, block, seq, raw, mark, message)``: raw lines of the files above a size, written once to the shared folder.

    Blocks, numbers and lines come from one reading of the files.
    """
    files = _files(spark, paths, types, recursive).filter((F.col("length") > above_bytes) & (F.col("length") > 0))
    target = scratch_path(spark, "lines")
    scan = line_ranges(files).withColumn("raw", F.col("raw").cast("string"))
    scan.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(scan.schema).parquet(target)


def block_table(scan: DataFrame, encoding: str | None = None) -> DataFrame:
    """One row per block of :func:`stored_scan`: ``path, block, lines_before, encoding, total_lines, message``.

    Summed up before the shuffle. A file of which one block could not be read has a message in all of them. The lines are
    not sorted, as they would be for the largest of texts: marks and messages are sets of at most one.
    """
    blocks = scan.groupBy("path", "block").agg(
        F.count("seq").alias("n"),
        F.bool_and(F.is_valid_utf8("raw")).alias("valid"),
        F.array_max(F.collect_set("mark")).alias("mark"),
        F.array_max(F.collect_set("message")).alias("message"),
    )
    whole = Window.partitionBy("path")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.coalesce(F.bool_and("valid").over(whole), F.lit(True))
    return blocks.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
        detected_encoding(F.max("mark").over(whole), valid, encoding).alias("encoding"),
        F.sum("n").over(whole).alias("total_lines"),
        F.max("message").over(whole).alias("message"),
    )


def number_lines(scan: DataFrame, blocks: DataFrame, head: int | None = None) -> DataFrame:
    """``lines(path, line_no, line)`` of a scan with its materialized block table.

    With ``head`` only the first lines of each file, which only blocks that hold some take part in. Files with a
    message leave no lines.
    """
    blocks = blocks.filter("message is null")
    if head is not None:
        blocks = blocks.filter(F.col("lines_before") < head)
    starts = checked_broadcast(blocks.select("path", "block", "lines_before", "encoding"))
    numbered = scan.join(starts, ["path", "block"]).withColumn("line_no", F.col("lines_before") + F.col("seq") + 1)
    if head is not None:
        numbered = numbered.filter(F.col("line_no") <= head)
    return numbered.select("path", "line_no", cs.decode_raw(F.col("raw"), F.col("encoding")).alias("line"))


def read_lines(
    spark: SparkSession,
    paths: str | list[str] | DataFrame,
    encoding: str | None = None,
    types: tuple[str, ...] = TEXT_TYPES,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    recursive: bool = False,
) -> DataFrame:
    """``lines(path, line_no, line)`` of text files of any size, each in its own charset.

    Files that cannot be read leave no lines; :func:`read_whole_files` and :func:`block_table` have their messages.
    """
    files = paths if isinstance(paths, DataFrame) else list_files(spark, paths, types, recursive)
    whole = read_whole_files(spark, files, encoding, types, whole_file_bytes)
    small = explode_lines(whole.select("path", "lines"))
    scan = stored_scan(spark, files, types, whole_file_bytes)
    blocks = materialize(block_table(scan, encoding))
    if blocks.isEmpty():
        return small
    return small.unionByName(number_lines(scan, blocks))
