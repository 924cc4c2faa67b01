"""Sparse cells to full rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.render import QUOTE_TEXT, render_field, render_row


def densify(cells: DataFrame, keys: tuple[str, ...] = ("path", "sheet", "row")) -> DataFrame:
    """One row per sheet row: ``fields array<struct<kind, text>>`` for columns 0..last.

    Needs ``col`` (null for a cell without reference), ``pos`` (place in the stored row), ``kind``
    and ``text``. Absent columns are empty. A row without any reference is as wide as it has
    cells, all of them empty, as cells are found by reference only. One shuffle on the row
    key; a row is bounded by the width of a sheet.
    """
    packed = cells.groupBy(*keys).agg(
        F.coalesce(F.max("col"), F.lit(0)).alias("_last"),
        F.count(F.lit(1)).cast("int").alias("_n"),
        F.array_sort(F.collect_list(F.struct("col", "pos", "kind", "text"))).alias("_cells"),
    )
    last = F.when(F.col("_last") == 0, F.col("_n") - 1).otherwise(F.col("_last"))
    # Of several cells with one reference the first stored one counts.
    placed = F.filter("_cells", lambda c: c["col"].isNotNull())
    firsts = F.filter(
        placed, lambda c, i: (i == 0) | (c["col"] != F.get(placed, i - 1)["col"])
    )
    lookup = F.map_from_entries(
        F.transform(firsts, lambda c: F.struct(c["col"], F.struct(c["kind"], c["text"])))
    )
    absent = F.struct(F.lit("empty").alias("kind"), F.lit("").alias("text"))
    return packed.withColumn("_by_col", lookup).select(
        *keys,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("_by_col", i), absent)
        ).alias("fields"),
    )


def render_lines(rows: DataFrame, separator: str = ";", quote_mode: int = QUOTE_TEXT) -> DataFrame:
    """Full rows as delimited text: the keys of the row and ``line``."""
    fields = F.transform("fields", lambda f: render_field(f["text"], f["kind"], separator, quote_mode))
    return rows.withColumn("line", render_row(fields, separator)).drop("fields")
