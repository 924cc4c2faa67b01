"""Dates in text and as day serials counted from 1899-12-30."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day zero of the serial, the open range of valid serials, years taken as dates.
EPOCH = "1899-12-30"
SERIAL_ABOVE = -657435.0
SERIAL_BELOW = 2958466.0
MIN_YEAR = 1900
MAX_YEAR = 2100

_DAY_MS = 86400000
_TIME = r"(?:[ T]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?: ?[AaPp][Mm]|Z)?))?\s*\z"
_HALF_DAY = r"[AaPp][Mm]\z"
# Orders of day and month; with a 2 also years of two digits, those up to 29 in this century and the others in the last.
DATE_ORDERS = ("dmy", "mdy", "dmy2", "mdy2")

# Date patterns, and the order the groups of the second take in an ISO date.
_YEAR_FIRST = rf"\A\s*[0-9]{{4}}([-/])[0-9]{{1,2}}\1[0-9]{{1,2}}{_TIME}"
_ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)?\z"
_YEAR_LAST = r"\A\s*([0-9]{{1,2}})([{marks}])([0-9]{{1,2}})\2({year})" + _TIME.replace("{", "{{").replace("}", "}}")
_DAY_FIRST = "{century}$4-$3-$1 $5"
_MONTH_FIRST = "{century}$4-$1-$3 $5"
_YEARS = (("[0-9]{4}", ""), ("[0-2][0-9]", "20"), ("[3-9][0-9]", "19"))


def parse_date(value: Column, date_order: str = "dmy") -> Column:
    """Date with optional time of day as ``timestamp_ntz``, else null.

    Year first, German, and day first or month first by ``date_order``, one of :data:`DATE_ORDERS`. A time may be of
    twelve hours with AM or PM, or of UTC with a Z. The first character
    spares most texts the patterns; what fits one is put in ISO order and cast.
    """
    if date_order not in DATE_ORDERS:
        raise ValueError(f"date_order is one of {', '.join(DATE_ORDERS)}")
    iso = F.when(value.rlike(_YEAR_FIRST), F.trim(F.replace(value, F.lit("/"), F.lit("-"))))
    if date_order.startswith("dmy"):
        year_last = [("./-", _DAY_FIRST)]
    else:
        year_last = [(".", _DAY_FIRST), ("/-", _MONTH_FIRST)]
    for year, century in _YEARS[: 3 if date_order.endswith("2") else 1]:
        for marks, order in year_last:
            pattern = _YEAR_LAST.format(marks=marks, year=year)
            iso = iso.when(value.rlike(pattern), F.rtrim(F.regexp_replace(value, pattern, order.format(century=century))))
    first = F.ascii(value)
    # The one-element array has the ISO form worked out once.
    any_form = F.get(F.transform(F.array(F.when(first.between(48, 57) | first.between(1, 32), iso)), _moment), F.lit(0))
    # What is in ISO order already is cast as it stands, at a fraction of the cost.
    return F.when(first.between(48, 57) & value.rlike(_ISO), value.try_cast("timestamp_ntz")).otherwise(any_form)


def _moment(iso: Column) -> Column:
    """A moment in ISO order; of half days by its pattern, of UTC without its mark."""
    half = F.upper(F.regexp_replace(F.replace(iso, F.lit("T"), F.lit(" ")), r" ?([AaPp][Mm])\z", " $1"))
    of_half = F.try_to_timestamp(half, F.lit("yyyy-M-d h:mm[:ss][.SSSSSS] a")).cast("timestamp_ntz")
    return F.when(iso.rlike(_HALF_DAY), of_half).otherwise(F.rtrim(iso, F.lit("Z")).try_cast("timestamp_ntz"))


def in_date_years(dt: Column) -> Column:
    """Years that count as dates when no rule asks for a date."""
    return F.year(dt).between(MIN_YEAR, MAX_YEAR)


def date_serial(dt: Column) -> Column:
    """Whole days plus the time of day as a fraction, to the microsecond; before day zero the fraction counts down."""
    days = F.date_diff(dt.cast("date"), F.lit(EPOCH).cast("date"))
    moment = dt.cast("timestamp_ntz")
    micros = (F.extract(F.lit("SECOND"), moment) * 1000000).cast("bigint")
    part = ((F.hour(moment) * 3600 + F.minute(moment) * 60).cast("bigint") * 1000000 + micros) / F.lit(86400e6)
    return F.when(days < 0, days - part).otherwise(days + part)


def serial_in_range(serial: Column) -> Column:
    return (serial > SERIAL_ABOVE) & (serial < SERIAL_BELOW)


def serial_date(serial: Column) -> Column:
    """The day of a serial, rounded to milliseconds; the time of day is dropped."""
    half = F.when(serial < 0, -0.5).otherwise(0.5)
    millis = (serial * _DAY_MS + half).cast("bigint")
    days = (F.signum(millis) * F.floor(F.abs(millis) / F.lit(_DAY_MS))).cast("int")
    return F.when(serial_in_range(serial), F.date_add(F.lit(EPOCH).cast("date"), days))


def serial_text(serial: Column) -> Column:
    return F.date_format(serial_date(serial), "yyyy-MM-dd")
