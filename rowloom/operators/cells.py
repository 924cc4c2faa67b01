"""Lines to typed cells, cells to column types, columns to typed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.cells import (
    DATE_STYLE,
    DECIMAL_STYLE,
    cell_style,
    date_candidate,
    number_candidate,
    override_code,
    style_kind,
)
from rowloom.functions.dates import parse_date
from rowloom.functions.numbers import finite, number_or_overflow, strict_integer
from rowloom.functions.refs import cell_ref
from rowloom.functions.split import field_quoted, field_value, raw_fields
from rowloom.session import checked_broadcast

# Profile columns the typing of a line depends on.
LINE_SETTINGS = ("separator", "start_line", "overrides")


def with_profile(lines: DataFrame, profile: DataFrame, columns: tuple[str, ...] = LINE_SETTINGS,
                 measured: bool = False) -> DataFrame:
    """Lines with the settings of their source.

    The profile has one row per source and may be large. With ``measured`` (the profile is a
    materialized table) its size is checked and a small one is broadcast, so the lines are
    not shuffled; otherwise Spark decides by its statistics and splits hot sources at run time.
    """
    settings = profile.select("path", *columns)
    if measured:
        settings = checked_broadcast(settings)
    return lines.join(settings, "path")


def type_fields(df: DataFrame, raw: Column, override: Column, date_order: str = "dmy") -> DataFrame:
    """Add the columns of a typed cell for the raw field ``raw``. No shuffle.

    Each step is a column of its own, so that a number or date is parsed once.
    """
    value, quoted, code, num, dt = (F.col(c) for c in ("text", "quoted", "_code", "num", "dt"))
    style = F.col("style")
    return (
        df.withColumns({"quoted": field_quoted(raw), "text": field_value(raw), "_code": override_code(override)})
        .withColumn("num", number_candidate(value, quoted, code))
        .withColumn("num", finite(num))
        .withColumn("dt", date_candidate(value, quoted, code, num, date_order))
        .withColumn("style", cell_style(code, num, dt))
        .withColumns({
            "num": F.when(style >= DECIMAL_STYLE, num),
            "dt": F.when(style == DATE_STYLE, dt),
            "kind": style_kind(style),
        })
        .drop("_code")
    )


def to_cells(lines: DataFrame, date_order: str = "dmy", sheet: str = "Tabelle1") -> DataFrame:
    """``cells`` of ``lines(path, line_no, line, separator, start_line, overrides)``. No shuffle.

    Every line from the start line on is a row, header and blank lines included; rows count
    from 1. Join the settings with :func:`with_profile` first.
    """
    kept = lines.filter(F.col("line_no") >= F.col("start_line"))
    row = F.col("line_no") - F.greatest(F.col("start_line"), F.lit(1)) + 1
    fields = kept.select(
        "path",
        row.alias("row"),
        "overrides",
        F.posexplode(raw_fields(F.col("line"), F.col("separator"))).alias("col", "_raw"),
    )
    override = F.get(F.col("overrides"), F.col("col"))
    typed = type_fields(fields, F.col("_raw"), override, date_order)
    return typed.select(
        "path",
        F.lit(sheet).alias("sheet"),
        "row",
        "col",
        cell_ref(F.col("col"), F.col("row")).alias("ref"),
        "kind",
        "text",
        "num",
        "dt",
        "style",
        "quoted",
    )


def column_types(cells: DataFrame, by: tuple[str, ...] = ("path", "col")) -> DataFrame:
    """Kinds per column rolled up to one type.

    Integers widen to decimal; dates mixed with anything else, and text, make text. Empty
    unquoted fields count as missing. Counts are summed up before the shuffle.
    """
    empty = (F.col("text") == "") & ~F.col("quoted")

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    counted = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        count(empty).alias("empty"),
        count((F.col("kind") == "text") & ~empty).alias("texts"),
        count(F.col("kind") == "integer").alias("integers"),
        count(F.col("kind") == "decimal").alias("decimals"),
        count(F.col("kind") == "date").alias("dates"),
    )
    numbers = F.col("integers") + F.col("decimals")
    data_type = (
        F.when(F.col("texts") > 0, "text")
        .when((F.col("dates") > 0) & (numbers > 0), "text")
        .when(F.col("dates") > 0, "date")
        .when(F.col("decimals") > 0, "decimal")
        .when(F.col("integers") > 0, "integer")
        .otherwise("text")
    )
    return counted.withColumn("data_type", data_type).withColumn(
        "null_rate", F.col("empty") / F.col("cells")
    )


# Spark type of a column type.
SPARK_TYPES = {"text": "string", "integer": "int", "decimal": "double", "date": "timestamp_ntz"}


def column_plan(types: DataFrame, path: str, names: list[str] | None = None) -> list[tuple[str, str]]:
    """``(name, data_type)`` per column of one source, read to the driver.

    A row has at most as many columns as a sheet (16,384), so the list is bounded.
    """
    rows = types.filter(F.col("path") == path).select("col", "data_type").orderBy("col").collect()
    width = max((r["col"] for r in rows), default=-1) + 1
    found = {r["col"]: r["data_type"] for r in rows}
    return list(zip(column_names(names or [], width), (found.get(i, "text") for i in range(width))))


# Columns of a typed table that are not fields.
OWN_COLUMNS = ("path", "line_no", "_rescued")


def column_names(names: list[str], width: int) -> list[str]:
    """``width`` names that differ also without regard to case, as Spark asks for.

    A name that is taken, by another column or one of :data:`OWN_COLUMNS`, gets the first free number; a column without a
    name is ``_c`` and its position, which no other column is given. Names that stand once keep their form whatever
    comes before them.
    """
    wanted = [names[i] if i < len(names) and names[i] else f"_c{i}" for i in range(width)]
    taken = {n.lower() for n in OWN_COLUMNS}
    plain, seen = set(), set()
    for i, name in enumerate(wanted):  # the first column of a name has it, so no number may make up another's name
        low = name.lower()
        position = re.fullmatch(r"_c([0-9]+)", low)
        if low not in taken and low not in seen and (position is None or low == f"_c{i}"):
            plain.add(i)
            seen.add(low)
    taken |= seen
    out = []
    for i, name in enumerate(wanted):
        number = 0
        while i not in plain and (number == 0 or f"{name}_{number}".lower() in taken):
            number += 1
        out.append(f"{name}_{number}" if number else name)
        taken.add(out[-1].lower())
    return out


def to_typed(
    lines: DataFrame,
    columns: list[tuple[str, str]],
    separator: Column | str,
    has_header: bool = False,
    start_line: int = 1,
    date_order: str = "dmy",
) -> DataFrame:
    """A typed wide table out of the lines of sources with the same columns. No shuffle.

    Empty unquoted fields are null, empty quoted ones empty text. What does not fit the type of
    its column, and fields beyond the last column, stay in the map ``_rescued``.
    """
    first = start_line + (1 if has_header else 0)
    width = len(columns)
    types = F.array(*[F.lit(t) for _, t in columns]) if columns else F.array().cast("array<string>")
    names = F.array(*[F.lit(n) for n, _ in columns]) if columns else F.array().cast("array<string>")

    def data_type(i: Column) -> Column:
        return F.coalesce(F.get(types, i), F.lit("text"))

    # Arrays keep the generated code as small for a thousand columns as for one.
    raw = lines.filter(F.col("line_no") >= first).select(
        "path", "line_no", raw_fields(F.col("line"), separator).alias("_raw")
    )
    parsed = raw.withColumns({
        "_n": F.transform("_raw", lambda r, i: number_or_overflow(
            r, ~field_quoted(r) & data_type(i).isin("integer", "decimal"))),
        "_d": F.transform("_raw", lambda r, i: F.when(
            ~field_quoted(r) & (data_type(i) == "date"), parse_date(r, date_order))),
    })
    checked = parsed.withColumn("_n", F.transform("_n", lambda n, i: F.when(
        data_type(i) == "integer", strict_integer(n).cast("double")).otherwise(finite(n))))

    def misfit(r: Column, i: Column) -> Column:
        untyped = F.get(F.col("_n"), i).isNull() & F.get(F.col("_d"), i).isNull()
        name = F.coalesce(F.get(names, i), F.concat(F.lit("_c"), i.cast("string")))
        return F.when(
            (i >= width) | ((r != "") & (data_type(i) != "text") & untyped),
            F.struct(name.alias("k"), r.alias("v")),
        )

    rescued = checked.withColumn(
        "_rescued", F.map_from_entries(F.array_compact(F.transform("_raw", misfit)))
    )

    def value(i: int, kind: str) -> Column:
        at = F.lit(i)
        if kind == "text":
            field = F.get(F.col("_raw"), at)
            return F.when(field != "", field_value(field))
        return F.get(F.col("_d" if kind == "date" else "_n"), at).cast(SPARK_TYPES[kind])

    return rescued.select(
        "path",
        "line_no",
        *[value(i, kind).alias(name) for i, (name, kind) in enumerate(columns)],
        F.when(F.size("_rescued") > 0, F.col("_rescued")).alias("_rescued"),
    )


# One typed cell of a line.
CELL = "array<struct<kind:string,text:string,num:double,dt:timestamp_ntz,style:int,quoted:boolean>>"


def with_typed_fields(lines: DataFrame, date_order: str = "dmy", name: str = "cells") -> DataFrame:
    """Add the typed cells of each line as an array. No shuffle, and the row stays a row.

    The array form of :func:`to_cells`, for sinks that want whole rows back: exploded cells
    would have to be shuffled together again.
    """
    over = F.col("overrides")
    fields = lines.withColumn(
        "_f",
        F.transform(
            raw_fields(F.col("line"), F.col("separator")),
            lambda r: F.struct(field_value(r).alias("value"), field_quoted(r).alias("quoted")),
        ),
    )
    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    coded = fields.withColumn("_o", F.transform("_f", lambda x, i: override_code(F.get(over, i))))
    numbers = coded.withColumn(
        "_n", F.transform("_f", lambda x, i: number_candidate(x["value"], x["quoted"], at("_o", i)))
    ).withColumn("_n", F.transform("_n", finite))
    dates = numbers.withColumn(
        "_d",
        F.transform("_f", lambda x, i: date_candidate(x["value"], x["quoted"], at("_o", i), at("_n", i), date_order)),
    )
    styles = dates.withColumn(
        "_s", F.transform("_f", lambda x, i: cell_style(at("_o", i), at("_n", i), at("_d", i)))
    )

    def cell(x: Column, i: Column) -> Column:
        style = at("_s", i)
        return F.struct(
            style_kind(style).alias("kind"),
            x["value"].alias("text"),
            F.when(style >= DECIMAL_STYLE, at("_n", i)).alias("num"),
            F.when(style == DATE_STYLE, at("_d", i)).alias("dt"),
            style.alias("style"),
            x["quoted"].alias("quoted"),
        )

    return styles.withColumn(name, F.transform("_f", cell)).drop("_f", "_o", "_n", "_d", "_s")
