"""Kinds of cells: typing text fields, resolving stored cells, styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.dates import date_serial, in_date_years, parse_date, serial_in_range, serial_text
from rowloom.functions.numbers import INT_MAX, INT_MIN, export_number, number_or_overflow

# What a rule can ask for.
OVERRIDES = ("Auto", "Text", "Integer", "Decimal", "Date")

# Kinds of typed cells by style index, and the number format of each style.
KINDS = ("text", "date", "decimal", "integer")
TEXT_STYLE, DATE_STYLE, DECIMAL_STYLE, INTEGER_STYLE = range(4)
FORMAT_OF_STYLE = {0: (0, "General"), 1: (164, "dd.mm.yyyy"), 2: (165, "#,##0.00"), 3: (1, "0")}

# Type codes of stored cells.
SHARED, BOOLEAN, STRING = "s", "b", "str"


def override_code(override: Column) -> Column:
    """Place of a type in OVERRIDES, 0 for none: compared faster than its name."""
    names = F.array(*[F.lit(o) for o in OVERRIDES])
    return F.coalesce(F.array_position(names, override) - 1, F.lit(0)).cast("int")


def number_candidate(value: Column, quoted: Column, code: Column) -> Column:
    """The field as number where its style can depend on it; may be infinite."""
    wanted = ~quoted & (code != OVERRIDES.index("Text")) & (code != OVERRIDES.index("Date"))
    return number_or_overflow(value, wanted)


def date_candidate(value: Column, quoted: Column, code: Column, num: Column, date_order: str) -> Column:
    """The field as date where its style can depend on it: asked for, or not a number."""
    wanted = ~quoted & ((code == OVERRIDES.index("Date")) | ((code == 0) & num.isNull()))
    return F.when(wanted, parse_date(value, date_order))


def cell_style(code: Column, num: Column, dt: Column) -> Column:
    """Style of a field, the first that fits: quoted, asked for by a rule, number, date, text.

    ``num`` and ``dt`` are the candidates for the field; both are null for a quoted one.
    """
    whole = num == F.floor(num)
    auto = (
        F.when(num.isNotNull(), F.when(whole & (F.abs(num) < INT_MAX), INTEGER_STYLE).otherwise(DECIMAL_STYLE))
        .when(in_date_years(dt), DATE_STYLE)
    )
    asked = (
        F.when((code == OVERRIDES.index("Date")) & dt.isNotNull(), DATE_STYLE)
        .when((code == OVERRIDES.index("Decimal")) & num.isNotNull(), DECIMAL_STYLE)
        .when((code == OVERRIDES.index("Integer")) & whole & num.between(INT_MIN, INT_MAX), INTEGER_STYLE)
    )
    return F.coalesce(F.when(code == 0, auto).otherwise(asked), F.lit(TEXT_STYLE))


def style_kind(style: Column) -> Column:
    """Kind of a typed cell by its style."""
    return F.get(F.array(*[F.lit(k) for k in KINDS]), style)


def style_format(style: Column) -> Column:
    """Format code of a style index."""
    chain = F.lit(None).cast("string")
    for index, (_, code) in FORMAT_OF_STYLE.items():
        chain = F.when(style == index, code).otherwise(chain)
    return chain


def is_date_format(format_id: Column, format_code: Column | None = None) -> Column:
    """Number formats that show dates, by id; with ``format_code`` own formats go by their code."""
    by_id = format_id.between(14, 22) | format_id.between(45, 47)
    if format_code is None:
        return F.coalesce(by_id | (format_id == 164), F.lit(False))
    bare = F.regexp_replace(format_code, r'"[^"]*"|\[[^\]]*\]|\\.', "")
    by_code = (format_id >= 164) & bare.rlike(r"(?i)[ymdhs]")
    return F.coalesce(by_id | by_code, F.lit(False))


def boolean_text(value: Column) -> Column:
    return F.when(value == "1", "TRUE").otherwise("FALSE")


def stored_kind(cell_type: Column, value: Column, num: Column, is_date: Column) -> Column:
    """Kind of a stored cell: shared string, boolean, string, dated number, number, text.

    ``num`` is the value parsed as a lenient number.
    """
    return (
        F.when(value.isNull(), "empty")
        .when(cell_type.isin(SHARED, STRING), "text")
        .when(cell_type == BOOLEAN, "boolean")
        .when(num.isNull(), "text")
        .when(is_date & serial_in_range(num), "date")
        .otherwise("number")
    )


def stored_text(kind: Column, cell_type: Column, value: Column, shared: Column, num: Column) -> Column:
    """Exported text of a stored cell. ``shared`` is the shared string it points to."""
    return (
        F.when(kind == "empty", "")
        .when(cell_type == SHARED, F.coalesce(shared, value))
        .when(kind == "boolean", boolean_text(value))
        .when((kind == "text") | num.isNull(), value)
        .when(kind == "date", serial_text(num))
        .otherwise(export_number(num))
    )


def stored_value(kind: Column, text: Column, num: Column, dt: Column, number_text: Column) -> Column:
    """What a typed cell stores: a number, a day serial or its text."""
    return (
        F.when(kind.isin("integer", "decimal"), number_text)
        .when(kind == "date", F.regexp_replace(date_serial(dt).cast("string"), r"\.0\z", ""))
        .otherwise(text)
    )
