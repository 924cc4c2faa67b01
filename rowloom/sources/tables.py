"""Lines out of tables: texts cut into lines, rows printed as delimited lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.render import QUOTE_NEVER, render_field, render_row
from rowloom.functions.split import line_array
from rowloom.operators.numbering import head_rows, number_rows
from rowloom.sources.text_files import explode_lines


def text_lines(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """``lines`` of a table with one whole text per row. No shuffle."""
    return explode_lines(df.select(path.alias("path"), line_array(text).alias("lines")))


def print_value(df: DataFrame, name: str) -> Column:
    """A column as text that loses nothing: doubles with all their places, at least two; times with fractions."""
    data_type = dict(df.dtypes)[name]
    text = F.col(name).cast("string")
    if data_type not in ("double", "float"):
        return text
    exact = text.try_cast("decimal(38,18)")
    digits = F.regexp_replace(exact.cast("string"), r"(\.[0-9]{2}[0-9]*?)0+\z", "$1")
    # what 38 digits do not hold stays as Spark prints it
    plain = F.when((exact.cast(data_type) == F.col(name)) & ~digits.contains("E"), digits).otherwise(text)
    # without an exponent the text of a double is exact, and needs at most a second place
    one_place = F.substring(text, -2, 1) == "."
    return F.when(text.contains("E"), plain).when(one_place, F.concat(text, F.lit("0"))).otherwise(text)


def print_kind(df: DataFrame, name: str) -> Column:
    """Kind a printed column has for the quoting rules."""
    data_type = dict(df.dtypes)[name]
    if data_type == "string":
        return F.lit("text")
    return F.lit("date" if data_type.startswith(("timestamp", "date")) else "number")


def print_line(df: DataFrame, columns: list[str], sep: str, mode: int = QUOTE_NEVER) -> Column:
    """The columns of a row as one delimited line."""
    return render_row([render_field(print_value(df, c), print_kind(df, c), sep, mode) for c in columns], sep)


def table_lines(df: DataFrame, path: Column, key: Column, columns: list[str], sep: str,
                mode: int = QUOTE_NEVER) -> DataFrame:
    """``lines`` of a table printed as delimited text, numbered by ``key`` within ``path``."""
    printed = df.select(path.alias("path"), key.alias("_order"), print_line(df, columns, sep, mode).alias("line"))
    return number_rows(printed, "path", F.col("_order")).select("path", "line_no", "line")


def table_head(df: DataFrame, path: Column, key: Column, columns: list[str], sep: str,
               n: int, mode: int = QUOTE_NEVER) -> DataFrame:
    """The first ``n`` lines of :func:`table_lines`, without numbering the rest."""
    printed = df.select(path.alias("path"), key.alias("_order"), print_line(df, columns, sep, mode).alias("line"))
    return head_rows(printed, "path", [F.col("_order")], n).select("path", "line_no", "line")
