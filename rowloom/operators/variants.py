"""Typed rows of unlike sources in one table: a VARIANT object per line, by the plan of its source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.dates import parse_date
from rowloom.functions.numbers import finite, number_or_overflow, strict_integer
from rowloom.functions.split import field_quoted, field_value, raw_fields
from rowloom.operators.cells import column_names, column_types, to_cells
from rowloom.session import checked_broadcast, materialize


def source_plans(types: DataFrame, names: DataFrame) -> DataFrame:
    """``(path, names, types)``: name and type of each column of each source, as arrays; materialized.

    ``types`` are :func:`column_types` and ``names(path, header_names)`` the header of each source, null without one. A row
    has at most as many columns as a sheet, so a plan is bounded; plans are as many as sources and stay in a table.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "data_type"))), lambda t: t["data_type"])
    planned = types.groupBy("path").agg(ordered.alias("types")).join(names.select("path", "header_names"), "path", "left")

    @F.pandas_udf("array<string>")
    def named(header: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([column_names([x or "" for x in h] if h is not None else [], int(w)) for h, w in zip(header, width)])

    return materialize(planned.select("path", named("header_names", F.size("types")).alias("names"), "types"))


def typed_rows(lines: DataFrame, plans: DataFrame, date_order: str = "dmy") -> DataFrame:
    """``(path, line_no, row, _rescued)`` of ``lines(path, line_no, line, separator)``, each by the plan of its source.

    ``row`` is an object of the fields that fit the type of their column. Empty unquoted fields are left out, as are
    columns beyond the end of a short line; empty quoted ones are empty text. What does not fit, and fields beyond the
    last column, stay in the map ``_rescued`` by their position from 0. No shuffle where the plans are small.
    """
    planned = lines.join(checked_broadcast(plans), "path")

    def kind(i: Column) -> Column:
        return F.coalesce(F.get(F.col("types"), i), F.lit("text"))

    # Arrays keep the generated code as small for a thousand columns as for one.
    parsed = planned.withColumn("_raw", raw_fields(F.col("line"), F.col("separator"))).withColumns({
        "_n": F.transform("_raw", lambda r, i: number_or_overflow(r, ~field_quoted(r) & kind(i).isin("integer", "decimal"))),
        "_d": F.transform("_raw", lambda r, i: F.when(~field_quoted(r) & (kind(i) == "date"), parse_date(r, date_order))),
    })
    checked = parsed.withColumn("_n", F.transform("_n", lambda n, i: F.when(
        kind(i) == "integer", strict_integer(n).cast("double")).otherwise(finite(n))))

    def value(r: Column, i: Column) -> Column:
        number, date = F.get(F.col("_n"), i), F.get(F.col("_d"), i)
        return (
            F.when((kind(i) == "integer") & number.isNotNull(), number.cast("int").cast("variant"))
            .when((kind(i) == "decimal") & number.isNotNull(), number.cast("variant"))
            .when((kind(i) == "date") & date.isNotNull(), date.cast("variant"))
            .when((kind(i) == "text") & (r != ""), field_value(r).cast("variant"))
        )

    def field(r: Column, i: Column) -> Column:
        name = F.get(F.col("names"), i)
        held = value(r, i)
        return F.when(name.isNotNull() & held.isNotNull(), F.struct(name.alias("k"), held.alias("v")))

    def misfit(r: Column, i: Column) -> Column:
        beyond = i >= F.size("types")
        untyped = (kind(i) != "text") & F.get(F.col("_n"), i).isNull() & F.get(F.col("_d"), i).isNull()
        return F.when(beyond | ((r != "") & untyped), F.struct(i.alias("k"), r.alias("v")))

    rows = checked.select(
        "path", "line_no",
        F.to_variant_object(F.map_from_entries(F.array_compact(F.transform("_raw", field)))).alias("row"),
        F.map_from_entries(F.array_compact(F.transform("_raw", misfit))).alias("_rescued"),
    )
    return rows.withColumn("_rescued", F.when(F.size("_rescued") > 0, F.col("_rescued")))


def typed_sources(lines: DataFrame, profile: DataFrame, date_order: str = "dmy") -> DataFrame:
    """:func:`typed_rows` of profiled sources: ``lines(path, line_no, line, separator, start_line, overrides)`` and their
    ``profile``. Header lines give the names, and are no rows; blank lines neither."""
    headed = checked_broadcast(materialize(profile.select("path", "has_header", "header_names")))
    body = lines.join(headed.select("path", "has_header"), "path").filter(
        F.col("line_no") >= F.col("start_line") + F.col("has_header").cast("int"))
    # rows of cells are counted from the start line, which is the header's where there is one
    cells = to_cells(body, date_order)
    plans = source_plans(column_types(cells), headed)
    return typed_rows(body.select("path", "line_no", "line", "separator").filter(F.col("line") != ""), plans, date_order)
