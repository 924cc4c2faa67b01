import datetime as dt

from pyspark.sql import functions as F

from rowloom.functions.cells import is_date_format, style_format, style_kind
from rowloom.functions.dates import date_serial, parse_date, serial_text
from rowloom.sources.tables import print_value
from rowloom.functions.numbers import export_number, number_text, parse_lenient_number, parse_number, strict_integer
from rowloom.functions.refs import (
    cell_ref, column_letters, output_path, path_base, ref_column, safe_sheet_name, sheet_path,
)
from rowloom.functions.render import render_field
from rowloom.operators.cells import type_fields

KINDS = {
    "42": ("integer", 42.0), "42.0": ("integer", 42.0), "42,0": ("integer", 42.0), "1e3": ("integer", 1000.0),
    "45.66": ("decimal", 45.66), "123,45": ("decimal", 123.45), ".5": ("decimal", 0.5), "-0,5": ("decimal", -0.5),
    "01234": ("integer", 1234.0), "2147483647": ("decimal", 2147483647.0), "10000000000": ("decimal", 1e10),
    " 7 ": ("integer", 7.0), "+3": ("integer", 3.0), "5.": ("integer", 5.0), "20250131": ("integer", 20250131.0),
    "1.234,56": ("text", None), "1,234.56": ("text", None), "12d": ("text", None), "-": ("text", None),
    "1e400": ("text", None), "9" * 400: ("text", None), "NaN": ("text", None), "Infinity": ("text", None),
    "- 5": ("text", None), "1e": ("text", None), "0x10": ("text", None),
    "2025-01-31": ("date", 45688.0), "31.01.2025": ("date", 45688.0), "31/01/2025": ("date", 45688.0),
    "2025/1/31": ("date", 45688.0), "2025-01-31 12:00": ("date", 45688.5), "2025-01-31T06:00:00": ("date", 45688.25),
    "01/31/2025": ("text", None), "2025-02-30": ("text", None), "31.12.1899": ("text", None),
    "01.01.2101": ("text", None), "2025-01/31": ("text", None), "1.2.25": ("text", None), "": ("text", None),
    "2025-01-31 25:00": ("text", None), "abc": ("text", None),
}


def typed(spark, raw, override=None, date_order="dmy"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, _raw string")
    over = F.lit(override).cast("string")
    rows = type_fields(df, F.col("_raw"), over, date_order).withColumn("serial", date_serial(F.col("dt")))
    return [(r["kind"], r["num"] if r["num"] is not None else r["serial"]) for r in rows.orderBy("i").collect()]


def test_kinds(spark):
    assert dict(zip(KINDS, typed(spark, KINDS))) == KINDS
    assert typed(spark, ['"001"', '"2025-01-31"']) == [("text", None), ("text", None)]
    assert typed(spark, ["01/31/2025"], date_order="mdy") == [("date", 45688.0)]


def test_overrides(spark):
    assert typed(spark, ["20.0", "42.5", "3000000000", "-2147483648", "1,0", "x", '"5"'], "Integer") == [
        ("integer", 20.0), ("text", None), ("text", None), ("integer", -2147483648.0), ("integer", 1.0),
        ("text", None), ("text", None),
    ]
    assert typed(spark, ["7", "7,5", "x"], "Decimal") == [("decimal", 7.0), ("decimal", 7.5), ("text", None)]
    assert typed(spark, ["01234"], "Text") == [("text", None)]
    assert typed(spark, ["31.12.1899", "abc", "5"], "Date") == [("date", 1.0), ("text", None), ("text", None)]
    assert typed(spark, ["5"], "Auto") == [("integer", 5.0)]


def test_integer_range(values):
    build = lambda v: strict_integer(parse_number(v))
    assert values(build, ["2147483647", "2147483648", "-2147483648", "1e-1"]) == [2147483647, None, -2147483648, None]


def test_lenient(values):
    found = values(parse_lenient_number, ["1,234.5", "(12)", "5-", "¤3", "$3", "1,2,3", "1.2.3", "(5", " 1e3 ", "", ",5"])
    assert found == [1234.5, -12.0, -5.0, 3.0, None, 123.0, None, None, 1000.0, None, None]


def test_export_number(values):
    cases = {
        434.0: "434", 19.9: "19,9", 123.456: "123,46", 2.675: "2,68", 0.001: "0", -0.001: "0", 0.005: "0,01",
        1e15: "1000000000000000", 123456789012345678.0: "123456789012346000", -2.5: "-2,5", 1e20: "1" + "0" * 20,
        2147483648.5: "2147483648,5", 12345.674999999999: "12345,68", 12345.67499999: "12345,67", 0.0: "0", 1e-9: "0", 99.999: "100", 10.0: "10",
        8.1: "8,1", 100.0: "100", 0.1 + 0.2: "0,3", 1.005: "1,01",
    }
    assert dict(zip(cases, values(export_number, list(cases), "double"))) == cases


def test_number_text(values):
    cases = {
        42.0: "42", 45.66: "45.66", 0.1 + 0.2: "0.3", 1e15: "1E+15", 1.5e-7: "1.5E-07", 0.000012345: "0.000012345",
        123456789012345678.0: "1.23456789012346E+17", -0.5: "-0.5", 1000.0: "1000",
    }
    assert dict(zip(cases, values(number_text, list(cases), "double"))) == cases


def test_serials(values):
    texts = {45688.0: "2025-01-31", 45688.6: "2025-01-31", 9999999.0: None, -1.25: "1899-12-29",
             45688.99999999999: "2025-02-01", 0.0: "1899-12-30", -657435.0: None, 2958465.0: "9999-12-31"}
    assert dict(zip(texts, values(serial_text, list(texts), "double"))) == texts
    days = [dt.datetime(2025, 1, 31, 18), dt.datetime(1899, 12, 28, 6)]
    assert values(date_serial, days, "timestamp_ntz") == [45688.75, -2.25]


def test_dates_by_order(values):
    assert values(lambda v: parse_date(v, "mdy"), ["1/31/2025 7:05"]) == [dt.datetime(2025, 1, 31, 7, 5)]


def test_dates_as_people_type_them(values):
    texts = {
        "12/31/2024 10:00 AM": dt.datetime(2024, 12, 31, 10), "12/31/2024 12:05 am": dt.datetime(2024, 12, 31, 0, 5),
        "31.12.2024 1:02:03PM": dt.datetime(2024, 12, 31, 13, 2, 3), "2024-12-31T11:59:59.5 pm": dt.datetime(2024, 12, 31, 23, 59, 59, 500000),
        "2024-12-31T10:00:00Z": dt.datetime(2024, 12, 31, 10), "31.12.2024 10:00Z": dt.datetime(2024, 12, 31, 10),
        "2024-12-31 13:00 PM": None, "2024-12-31Z": None, "31.12.24": None, "2024/1/2 0:30 AM": None,
    }
    assert values(lambda v: parse_date(v, "mdy"), list(texts)) == list(texts.values())
    short = {"31.12.24": 2024, "1.2.29 10:00": 2029, "1.2.30": 1930, "1-2-99": 1999, "1/2/00": 2000, "1.2.3": None, "32.1.24": None}
    assert [d and d.year for d in values(lambda v: parse_date(v, "dmy2"), list(short))] == list(short.values())
    assert values(lambda v: parse_date(v, "mdy2"), ["1/31/25", "31.1.25", "31/1/25"]) == [dt.datetime(2025, 1, 31)] * 2 + [None]


def test_refs(values):
    letters = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 1377: "AZZ", 1378: "BAA", 16383: "XFD"}
    assert values(column_letters, list(letters), "int") == list(letters.values())
    assert values(lambda v: ref_column(cell_ref(v, F.lit(7))), list(range(0, 16384, 7)), "int") == list(range(0, 16384, 7))
    assert values(ref_column, ["B7", "7", "", "XFD1048576"]) == [1, 0, 0, 16383]


def test_names(values):
    assert values(safe_sheet_name, ["a b:c/d\\e", "", None, 'x<>"|?*y', "Übersicht"]) == [
        "a_b_c_d_e", "Sheet", "Sheet", "x______y", "Übersicht"]
    assert values(output_path, ["/a/b.csv", "/a/b.XLSX", "c.tar.txt"]) == ["/a/b.xlsx", "/a/b.csv", "c.tar.xlsx"]
    assert values(lambda v: output_path(v, F.lit("/o")), ["/a/b.csv"]) == ["/o/b.xlsx"]
    assert values(lambda v: sheet_path(v, F.lit("S 1")), ["/a/b.csv", "b.csv"]) == ["/a/b_S_1.csv", "b_S_1.csv"]
    assert values(path_base, ["/a/b.c.csv", "x"]) == ["b.c", "x"]


def test_quote_modes(spark):
    cells = [("a", "text"), ('4" x', "text"), ("19,99", "number"), ("", "empty"), ("a;b", "text"), ("2025-01-31", "date")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, v string, k string")
    for mode, expected in {
        0: ["a", '4" x', "19,99", "", "a;b", "2025-01-31"],
        1: ['"a"', '"4"" x"', "19,99", '""', '"a;b"', "2025-01-31"],
        2: ['"a"', '"4"" x"', '"19,99"', '""', '"a;b"', '"2025-01-31"'],
    }.items():
        got = df.select("i", render_field(F.col("v"), F.col("k"), ";", mode).alias("r")).orderBy("i").collect()
        assert [r["r"] for r in got] == expected
    comma = df.filter("i = 2").select(render_field(F.col("v"), F.col("k"), ",", 1).alias("r")).first()
    assert comma["r"] == '"19,99"'


def test_styles(values):
    assert values(style_kind, [0, 1, 2, 3], "int") == ["text", "date", "decimal", "integer"]
    assert values(style_format, [0, 1, 2, 3], "int") == ["General", "dd.mm.yyyy", "#,##0.00", "0"]
    ids = [13, 14, 22, 23, 45, 47, 48, 164, 165, None]
    assert values(is_date_format, ids, "int") == [False, True, True, False, True, True, False, True, False, False]
    by_code = lambda code: values(lambda v: is_date_format(v, F.lit(code)), [164], "int")
    assert by_code("0.00") == [False] and by_code("yyyy-mm") == [True] and by_code('"day" 0') == [False]


def test_printing_loses_nothing(spark):
    df = spark.sql("""select * from values (1.5D, timestamp_ntz'2024-01-01 00:00:07.179575'),
        (0.0D, timestamp_ntz'2024-01-01 10:00:00'), (1234567.891D, null), (1e30D, null), (1e-20D, null), (-2.125D, null)
        as t(x, ts)""")
    got = [tuple(r) for r in df.select(print_value(df, "x"), print_value(df, "ts")).collect()]
    assert [x for x, _ in got] == ["1.50", "0.00", "1234567.891", "1.0E30", "1.0E-20", "-2.125"]
    assert [t for _, t in got][:2] == ["2024-01-01 00:00:07.179575", "2024-01-01 10:00:00"]


def test_fractions_of_a_second(values):
    texts = ["2024-01-01 00:00:07.179575", "31.12.2024 10:00:00.5", "2024-01-01T12:00:00.1234567"]
    dates = values(parse_date, texts)
    assert [str(d) for d in dates] == ["2024-01-01 00:00:07.179575", "2024-12-31 10:00:00.500000", "None"]
    import datetime
    half = datetime.datetime(1899, 12, 31, 0, 0, 0, 500000)
    assert values(date_serial, [half], "timestamp_ntz") == [1 + 0.5 / 86400]


def test_iso_dates_are_cast_as_they_stand(spark):
    """ISO order takes the short way, with the results of the long one: a blank before makes a text take that."""
    import re

    texts = ["2024-01-31", "2024-02-30", "0000-00-00", "2024-01-01 00:00:11.172425", "2024-01-01 00:00:11.1", "2024-13-01 01:02:03",
             "2024-01-01 24:00:00", "2024-01-01 23:59:60", "1582-10-10", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date(F.col("t")).alias("short"),
                                                                         parse_date(F.concat(F.lit(" "), F.col("t"))).alias("long"))
    rows = df.select("t", F.col("short").cast("string").alias("short"), F.col("long").cast("string").alias("long")).collect()
    assert [(r["t"], r["short"]) for r in rows] == [(r["t"], r["long"]) for r in rows]
    assert rows[3]["short"] == "2024-01-01 00:00:11.172425" and rows[1]["short"] is None
    plan = re.sub(r"t#\d+", "t", df._jdf.queryExecution().optimizedPlan().toString())
    assert "THEN try_cast(t as timestamp_ntz) ELSE transform" in plan
