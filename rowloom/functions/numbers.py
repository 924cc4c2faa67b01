"""Numbers in text: English and German notation in, stored and exported notation out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a 32-bit integer.
INT_MAX = 2147483647
INT_MIN = -2147483648

_SPACE = r"[\t-\r ]*"

# One optional sign, digits, at most one decimal mark (point or comma), optional exponent.
# No thousands marks; the words for infinity and not-a-number are no numbers here.
NUMBER = rf"\A{_SPACE}[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?{_SPACE}\z"

# The lenient form: thousands commas, a trailing sign, parentheses, the neutral currency sign.
_CORE = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
LENIENT_NUMBER = (
    rf"\A{_SPACE}(?:[+-]?¤?{_CORE}¤?|¤?[+-]{_CORE}|¤?{_CORE}{_SPACE}[+-]¤?|\(¤?{_CORE}¤?\)){_SPACE}\z"
)


def finite(n: Column) -> Column:
    """Overflow is no number. Pass a column, not an expression: it is read twice."""
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def _may_start_number(value: Column) -> Column:
    """By its first character alone: digit, sign, mark or white space. Spares texts the regex."""
    first = F.ascii(value)
    return first.between(43, 57) | first.between(1, 32)


def number_or_overflow(value: Column, wanted: Column | bool = True) -> Column:
    """English or German number as double, infinite where it is too large, else null."""
    guard = wanted & _may_start_number(value) if isinstance(wanted, Column) else _may_start_number(value)
    return F.when(guard & value.rlike(NUMBER), F.replace(value, F.lit(","), F.lit(".")).try_cast("double"))


def parse_number(value: Column) -> Column:
    """English or German number as double, else null."""
    n = number_or_overflow(value)
    # Only exponents and very long texts can overflow.
    safe = ~value.rlike("[eE]") & (F.length(value) < 300)
    return F.when(safe, n).otherwise(finite(n))


def lenient_or_overflow(value: Column) -> Column:
    """English number in any common notation as double, infinite where it is too large, else null."""
    plain = _may_start_number(value) & ~value.contains(",") & value.rlike(NUMBER)
    sign = F.when(value.rlike(rf"[(]|-¤?{_SPACE}\z"), -1.0).otherwise(1.0)
    bare = F.regexp_replace(value, rf"[+-]¤?{_SPACE}\z|[^0-9.eE+-]", "")
    return F.when(plain, value.try_cast("double")).when(
        value.rlike(LENIENT_NUMBER), bare.try_cast("double") * sign
    )


def parse_lenient_number(value: Column) -> Column:
    """English number in any common notation as double, else null."""
    n = lenient_or_overflow(value)
    safe = ~value.rlike("[eE]") & (F.length(value) < 300)
    return F.when(safe, n).otherwise(finite(n))


def is_integral(n: Column) -> Column:
    """Whole and below the largest 32-bit integer in size."""
    return (n == F.floor(n)) & (F.abs(n) < INT_MAX)


def strict_integer(n: Column) -> Column:
    """A whole number in 32-bit range as int, else null (``n`` as parsed by parse_number)."""
    return F.when((n == F.floor(n)) & n.between(INT_MIN, INT_MAX), n.cast("int"))


def _rounded(n: Column) -> Column:
    """``n`` at 15 significant digits, half away from zero, for 1e-5 <= abs(n) < 1e15.

    The shortest text of a double seldom has more digits; only then it is formatted anew.
    """
    text = n.cast("string")
    return F.when(F.length(text) <= 16, text).otherwise(_scientific(n)).try_cast("decimal(38,20)")


def _strip_zeros(decimal: Column) -> Column:
    """Text of a decimal without zeros behind its last digit, nor a bare point."""
    return F.rtrim(F.rtrim(decimal.cast("string"), F.lit("0")), F.lit("."))


def _scientific(n: Column) -> Column:
    """15 significant digits, e.g. 1.23450000000000e+02. Slow; for very large and small numbers."""
    return F.format_string("%.14e", n)


def _whole(n: Column) -> Column:
    return (n == F.floor(n)) & (F.abs(n) < 1e15)


def number_text(n: Column) -> Column:
    """Stored form: up to 15 digits, point as decimal mark, exponent only when far from 1."""
    sci = _scientific(n)
    mantissa = F.rtrim(F.rtrim(F.regexp_extract(sci, r"\A(-?[0-9.]+)e", 1), F.lit("0")), F.lit("."))
    far = F.concat(mantissa, F.lit("E"), F.regexp_extract(sci, r"e([+-][0-9]+)\z", 1))
    return (
        F.when(_whole(n), n.cast("bigint").cast("string"))
        .when(F.abs(n).between(1e-5, 999999999999999.0), _strip_zeros(_rounded(n)))
        .when(n.isNotNull(), far)
    )


def export_number(n: Column) -> Column:
    """Exported form: at most two places, comma as decimal mark, no thousands marks.

    Rounding starts from 15 digits, half away from zero.
    """
    sci = _scientific(n)
    digits = F.regexp_extract(F.replace(sci, F.lit("."), F.lit("")), r"\A-?([0-9]+)e", 1)
    places = F.regexp_extract(sci, r"e([+-][0-9]+)\z", 1).try_cast("int") + 1
    large = F.concat(F.when(n < 0, "-").otherwise(""), F.rpad(digits, places, F.lit("0")))
    two = F.round(_rounded(n), 2)
    return (
        F.when(_whole(n), n.cast("bigint").cast("string"))
        .when(F.abs(n) < 1e-5, "0")
        .when(F.abs(n) < 1e15, F.replace(_strip_zeros(two), F.lit("."), F.lit(",")))
        .when(n.isNotNull(), large)
    )
