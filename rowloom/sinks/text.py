"""Rendered lines as delimited text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.charset import BOM, UTF8, encode_raw

# Fixed value: line end of written text.
LINE_END = "\r\n"


def write_lines(
    lines: DataFrame,
    target: str,
    order: list[str],
    by: list[str] | None = None,
    encoding: str = UTF8,
    bom: bool = False,
    line_end: str = LINE_END,
    mode: str = "errorifexists",
) -> None:
    """Write ``line`` in the order given, one folder per value of ``by``.

    Range partitioning keeps the order across part files, so that reading or joining them by
    name gives the whole text, and a large output is written by many tasks.
    """
    by = by or []
    value = F.col("line")
    if bom and encoding == UTF8:  # before the first row there is, which need not be row 1
        output = by or [F.lit(0).alias("_output")]
        firsts = lines.groupBy(*output).agg(F.min(F.struct(*order)).alias("_first"))  # one small row per output
        lines = lines.withColumn("_output", F.lit(0)).join(F.broadcast(firsts) if not by else firsts, by or ["_output"])
    ordered = lines.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    if bom and encoding == UTF8:
        first = F.struct(*order) == F.col("_first")
        value = F.when(first, F.concat(F.lit(BOM), value)).otherwise(value)
    writer = ordered.select(*by, encode_raw(value, encoding).alias("value")).write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.option("lineSep", line_end).text(target)
