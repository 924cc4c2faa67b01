from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rowloom.functions.render import render_field, render_row
from rowloom.functions.split import is_blank, line_array, plain_names, split_fields

GOLDENS = {
    "a;b;c": ["a", "b", "c"],
    "a;;c": ["a", "", "c"],
    "a;b;": ["a", "b", ""],
    ";": ["", ""],
    "": [],
    "  ": ["  "],
    '"a;b";c': [("a;b",), "c"],
    '"say ""hi""";x': [('say "hi"',), "x"],
    '"a"b;c': [("a",), "b", "c"],
    '"abc': [("abc",)],
    '"abc;': [("abc;",), ""],
    'x"y";z': ['x"y"', "z"],
    ' "a";b': [' "a"', "b"],
    '"";x': [("",), "x"],
    '"a";': [("a",), ""],
    '""""': [('"',)],
    '"abc""': [('abc"',)],
}


def slow_split(line, sep):
    """The rules spelled out character by character, to check against."""
    fields, at = [], 0
    while at < len(line):
        if line[at] == '"':
            end = at + 1
            while end < len(line):
                if line[end] == '"':
                    if line[end + 1:end + 2] != '"':
                        break
                    end += 1
                end += 1
            fields.append((line[at + 1:end].replace('""', '"'), True))
            at = end + 1
            if sep and line[at:at + 1] == sep:
                at += 1
        else:
            end = line.find(sep, at) if sep else -1
            end = len(line) if end < 0 else end
            fields.append((line[at:end], False))
            at = end + 1
    if sep and line.endswith(sep):
        fields.append(("", False))
    return fields


def pairs(cells):
    return [(c["value"], c["quoted"]) for c in cells]


def test_goldens(values):
    expected = [[(f[0], True) if isinstance(f, tuple) else (f, False) for f in fs] for fs in GOLDENS.values()]
    assert [pairs(r) for r in values(lambda v: split_fields(v, ";"), list(GOLDENS))] == expected
    by_column = values(lambda v: split_fields(v, F.when(v != "never", ";")), list(GOLDENS))
    assert [pairs(r) for r in by_column] == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text('a";,|\t: b', max_size=14), min_size=30, max_size=60))
def test_same_as_slow_split(spark, lines):
    rows = [(i, x, s) for i, x in enumerate(lines) for s in (";", ",", "|", "\t", ":", "")]
    df = spark.createDataFrame(rows, "i int, line string, sep string")
    got = df.select("line", "sep", split_fields(F.col("line"), F.col("sep")).alias("f")).collect()
    for r in got:
        assert pairs(r["f"]) == slow_split(r["line"], r["sep"]), (r["line"], r["sep"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text('a";,0 .', max_size=6), min_size=1, max_size=5), min_size=20, max_size=40),
       st.sampled_from([1, 2]))
def test_render_then_split(spark, rows, mode):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f array<string>")
    rendered = F.transform("f", lambda x: render_field(x, F.lit("text"), ";", mode))
    lines = df.select("f", render_row(rendered, ";").alias("line"))
    for r in lines.select("f", split_fields(F.col("line"), ";").alias("g")).collect():
        assert [c["value"] for c in r["g"]] == r["f"]


def test_long_quoted_field(values):
    line = '"' + 'a""' * 300000 + '";' + "x" * 500000
    lengths = values(lambda v: F.transform(split_fields(v, ";"), lambda f: F.length(f["value"])), [line])
    assert lengths == [[600000, 500000]]


def test_lines(values):
    texts = ["a\nb\r\nc\rd", "a\n", "\n", "", "a\n\nb\n"]
    assert values(line_array, texts) == [["a", "b", "c", "d"], ["a"], [""], [], ["a", "", "b"]]


def test_blank_and_names(values):
    assert values(is_blank, ["", " \t", " ", "a", None]) == [True, True, True, False, True]
    assert values(lambda v: plain_names(v, ";"), [' "a" ;b;""c""', "x"]) == [["a", "b", "c"], ["x"]]
    assert values(lambda v: plain_names(v, ""), ["a;b"]) == [["a;b"]]
