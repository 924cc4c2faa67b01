"""Typed values as delimited text under three quoting policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.split import as_separator

# Quote modes.
QUOTE_NEVER, QUOTE_TEXT, QUOTE_ALL = 0, 1, 2


def render_field(value: Column, kind: Column, sep: Column | str, mode: int = QUOTE_TEXT) -> Column:
    """A field as delimited text.

    Mode 0 never quotes, even where the value holds the separator. Mode 1 quotes text, empty
    fields, and whatever holds a separator, quote or line end. Mode 2 quotes everything.
    """
    if mode not in (QUOTE_NEVER, QUOTE_TEXT, QUOTE_ALL):
        raise ValueError("quote mode is 0, 1 or 2")
    raw = F.coalesce(value, F.lit(""))
    if mode == QUOTE_NEVER:
        return raw
    quoted = F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit('""')), F.lit('"'))
    if mode == QUOTE_ALL:
        return quoted
    needs = (
        (raw == "")
        | kind.isin("text", "empty")
        | F.contains(raw, as_separator(sep))
        | raw.rlike(r'["\r\n]')
    )
    return F.when(needs, quoted).otherwise(raw)


def render_row(fields: list[Column] | Column, sep: Column | str) -> Column:
    """Rendered fields joined by the separator."""
    values = fields if isinstance(fields, Column) else F.array(*fields)
    return F.array_join(values, sep) if isinstance(sep, str) else F.call_function("array_join", values, sep)
