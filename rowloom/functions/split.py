"""Lines and fields: separators, quote-aware splitting, blank lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators tried in auto mode, in order of preference.
AUTO_SEPARATORS = (",", ";", "\t", "|")

# The separator column holds this when no separator was found: the whole line is one field.
NO_SEPARATOR = ""

# CR, LF and CRLF end a line.
LINE_END = r"\r\n|\r|\n"

BLANK = r"(?U)^\s*$"


# Stands in for "no separator" where a character is needed; text lines do not hold it.
_ABSENT = "\0"


def as_separator(sep: Column | str) -> Column:
    return F.lit(sep) if isinstance(sep, str) else sep


def _mark(sep: Column | str) -> Column:
    """The separating character."""
    if isinstance(sep, str):
        return F.lit(sep or _ABSENT)
    return F.when(sep == NO_SEPARATOR, _ABSENT).otherwise(sep)


def _pattern(sep: Column | str) -> Column:
    """The separating character as a regex, inside and outside a character class.

    An escaped single character is split at without compiling a pattern.
    """
    if isinstance(sep, str):
        return F.lit("\\" + (sep or _ABSENT))
    return F.concat(F.lit("\\"), _mark(sep))


def split_plain(line: Column, sep: Column | str) -> Column:
    """Parts of a line between separators, quotes ignored."""
    return F.split(line, _pattern(sep), -1)


def is_blank(line: Column) -> Column:
    """Null, empty or white space only."""
    return line.isNull() | line.rlike(BLANK)


def line_array(text: Column) -> Column:
    """The lines of a text. A final line end starts no further line.

    A single character is split at without a pattern, so only texts with a CR take one.
    """
    parts = F.when(F.contains(text, F.lit("\r")), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def field_pattern(sep: Column | str) -> Column:
    """Regex whose group 1 is one raw field, quotes included, separator left out.

    A quoted field runs to the first quote not followed by another, else to the end of the
    line, and takes one directly following separator with it. Any other field runs to the
    next separator.
    """
    quoted = r'("(?:[^"]++|"")*+(?:"|\z)'
    s = _pattern(sep)
    return F.concat(
        F.lit(quoted + r'|[^"'), s, F.lit("][^"), s, F.lit("]*+|(?="), s, F.lit("))"), s, F.lit("?")
    )


def raw_fields(line: Column, sep: Column | str) -> Column:
    """The raw fields of a line: quoted ones still in quotes. An empty line has none.

    Only a line with a quote in it needs the pattern; a plain split says the same of any other
    at a fraction of the cost. Pass ``line`` as a column, not as an expression: it is read
    more than once.
    """
    matched = F.regexp_extract_all(line, field_pattern(sep), F.lit(1))
    # A separator at the end of the line is followed by one more, empty field.
    last = F.when(F.endswith(line, _mark(sep)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(line.contains('"'), F.concat(matched, last))
        .otherwise(split_plain(line, sep))
    )


def field_quoted(raw: Column) -> Column:
    return raw.startswith('"')


def field_value(raw: Column) -> Column:
    """Value of a raw field: outer quotes dropped, doubled ones made single."""
    inner = F.replace(F.regexp_extract(raw, r'\A"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))
    return F.when(field_quoted(raw), inner).otherwise(raw)


def split_fields(line: Column, sep: Column | str) -> Column:
    """``array<struct<value:string, quoted:boolean>>`` of a line."""
    return F.transform(
        raw_fields(line, sep),
        lambda raw: F.struct(field_value(raw).alias("value"), field_quoted(raw).alias("quoted")),
    )


def plain_names(line: Column, sep: Column | str) -> Column:
    """Header-name clean-up: plain split, white space trimmed, then all edge quotes."""
    return F.transform(split_plain(line, sep), lambda p: F.regexp_replace(trim_space(p), r'\A"+|"+\z', ""))


def trim_space(value: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")


def separator_count(text: Column, sep: str) -> Column:
    """Occurrences of ``sep`` in a text, quotes ignored."""
    return (F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))).cast("bigint")
