"""Features made for large inputs, against their plain forms: full profiles, common strings, many rules."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators.profile import profile_files, profile_lines
from rowloom.plans.convert import Options, read_text
from rowloom.rules import _key, required_text, resolve_overrides
from rowloom.sources import workbooks
from rowloom.sources.workbooks import hot_strings, resolve_cells, with_shared


def sources(seed):
    rng = random.Random(seed)
    for path in range(25):
        blank = [rng.choice(["", " ", "\t", "\t\t "]) for _ in range(rng.randrange(4))]
        sep = rng.choice(";,|\t")
        body = [rng.choice(["", "\t", sep.join(rng.choice(["1", "x", '"a;b"', "", "name", "2,5"]) for _ in range(rng.choice([3, 3, 3, 2])))])
                for _ in range(rng.randrange(30))]
        for i, line in enumerate(blank + body, 1):
            yield f"f{path}", i, line


@pytest.mark.parametrize("given", [{}, {"separator": ";"}, {"header": True}, {"candidates": (";", "\t")}])
def test_profile_of_all_lines(spark, given):
    lines = spark.createDataFrame(list(sources(1)), "path string, line_no long, line string").repartition(4)
    merged = profile_files(lines, analyze_lines=None, **given)
    gathered = profile_files(lines, analyze_lines=10**9, **given).select(*merged.columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, gathered.collect()))
    assert "collect_list" not in profile_lines(lines)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("whole_bytes", [1 << 24, -1])
def test_files_are_profiled_by_all_lines(spark, tmp_path, whole_bytes):
    (tmp_path / "late.csv").write_text("a;b\n" * 150 + "c|d|e|f|g;h\n" * 200)
    row = read_text(spark, str(tmp_path), Options(analyze_lines=None, whole_file_bytes=whole_bytes)).profile.first()
    assert (row["separator"], row["analyzed_lines"], row["is_field_count_equal"]) == ("|", 350, False)
    assert read_text(spark, str(tmp_path), Options(whole_file_bytes=whole_bytes)).profile.first()["separator"] == ";"


def test_common_strings(spark):
    """One string in nine cells of ten: no key of the shuffle holds more than its share."""
    rng = random.Random(2)
    rows = [("b", i, i + 1, "A1", 0, *(("s", "7") if i % 10 else rng.choice([("s", str(rng.randrange(50))), (None, "3.5"), ("s", "999")])))
            for i in range(5000)]
    cells = spark.createDataFrame(rows, "path string, row_seq long, row long, ref string, s int, t string, v string").select(
        "path", F.lit("S").alias("sheet"), F.lit(0).alias("ordinal"), "row_seq", "row", F.lit(0).alias("pos"), "ref", "s", "t", "v",
        F.array(F.lit(1)).alias("dated"))
    strings = spark.createDataFrame([("b", i, f"text {i}") for i in range(50)], "path string, idx long, shared string")
    hot = hot_strings(cells, strings, 200)
    assert [r["idx"] for r in hot.collect()] == [7]
    plain, split = (sorted(map(repr, resolve_cells(cells, strings, h).collect())) for h in (None, hot))
    assert plain == split
    keys = with_shared(cells, strings, hot).groupBy("idx").count()
    assert keys.agg(F.max("count")).first()[0] <= 200
    assert with_shared(cells, strings).groupBy("idx").count().agg(F.max("count")).first()[0] > 4000


def test_large_dictionaries_take_the_shuffle(spark, tmp_path, monkeypatch):
    from test_batch import book

    (tmp_path / "b.xlsx").write_bytes(book({"One": [["0", "1"]] * 300}))
    plain = sorted(map(repr, workbooks.read_workbook_cells(spark, str(tmp_path / "b.xlsx")).collect()))
    monkeypatch.setattr(workbooks, "is_small", lambda df, *rest: False)
    monkeypatch.setattr(workbooks, "HOT_STRING", 100)
    assert sorted(map(repr, workbooks.read_workbook_cells(spark, str(tmp_path / "b.xlsx")).collect())) == plain and len(plain) == 600


def nested_loop(names, rules):
    hit = F.when(F.col("is_regex"), F.expr("_key rlike concat('(?iu)', pattern)")).otherwise(F.col("_key").contains(F.lower("pattern")))
    keyed = names.select("name").distinct().withColumn("_key", _key(F.col("name")))
    matched = keyed.join(F.broadcast(rules), (F.col("_key") != "") & hit, "left")
    return matched.groupBy("name").agg(F.coalesce(F.min_by("data_type", "priority"), F.lit("Auto")).alias("data_type"))


def test_many_rules_equal_the_nested_loop(spark):
    rng = random.Random(4)
    letters = "abkiIsSß_- 1ſİıK"

    def word(least, most):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(least, most)))

    shapes = [lambda: (word(1, 6), False), lambda: ("^" + word(3, 6), True), lambda: (word(3, 5) + ".*" + word(2, 5), True),
              lambda: (f"({word(2, 4)}|{word(2, 4)})", True), lambda: (word(3, 6) + "?", True), lambda: ("[ab]" + word(3, 5) + "{2}", True),
              lambda: (r"\bk" + word(2, 4), True), lambda: (r"\d+" + word(2, 5), True), lambda: (r"a\.b" + word(3, 5), True),
              lambda: (r"\x41" + word(2, 5), True), lambda: ("[a[b]k]" + word(3, 4), True), lambda: ("(?i)" + word(3, 5), True)]
    rules = [(i, *rng.choice(shapes)(), rng.choice(["Text", "Date", "Integer"])) for i in range(400)]
    names = [word(0, 14) for _ in range(600)] + [None, "", "  ", "ID"]
    names_df = spark.createDataFrame([(n,) for n in names], "name string")
    rules_df = spark.createDataFrame(rules, "priority int, pattern string, is_regex boolean, data_type string")
    expected = {r["name"]: r["data_type"] for r in nested_loop(names_df, rules_df).collect()}
    got = resolve_overrides(names_df, rules_df).collect()
    assert len(got) == len(expected) and {r["name"]: r["data_type"] for r in got} == expected
    assert len(set(expected.values())) == 4 or "Auto" in expected.values()


@pytest.mark.parametrize(("pattern", "is_regex", "text"), [
    ("preis", False, "preis"), ("a.b", False, "a"), ("^kunden.*nr$", True, "kunden"), ("(a|bcd)", True, ""), ("abcd?", True, "abc"),
    ("x{0}abc", True, "abc"), (r"\d+wert", True, "wert"), (r"\x41bc", True, ""), ("[abc]def", True, "def"), ("[a[b]cde]", True, ""),
    (r"a\.bcd", True, "bcd"), ("Größe", False, "gr"), ("", True, ""), ("ab*cde+", True, "cd"), (r"\\abc", True, "abc"),
])
def test_required_text(pattern, is_regex, text):
    assert required_text(pattern, is_regex) == text


def test_unlike_sources_in_one_table(spark):
    import datetime as dt

    from rowloom.operators.profile import profile_files
    from rowloom.operators.cells import with_profile
    from rowloom.operators.variants import typed_rows, typed_sources

    files = {
        "clash": ["ID;id;a;a;a_1", "1;x;2;3;4;5", "y;x;2;q;4"] + ["7;z;1;1;1"] * 3,
        "dates": ["", "Datum,Preis,,Text", "31.12.2024,1.5,7,\"\"", "1.1.2025,2,,\"a,b\"", "nie,2", ""],
        "bare": ["1|2", "3|x"],
    }
    lines = spark.createDataFrame([(p, i, x) for p, rows in files.items() for i, x in enumerate(rows, 1)], "path string, line_no long, line string")
    profile = profile_files(lines)
    typed = typed_sources(with_profile(lines, profile), profile)
    got = {(r["path"], r["line_no"]): (r["row"].toPython(), r["_rescued"]) for r in typed.collect()}
    assert got["clash", 2] == ({"ID": "1", "id_1": "x", "a": 2, "a_2": "3", "a_1": 4, "_c5": 5}, None)
    assert got["clash", 3][0] == {"ID": "y", "id_1": "x", "a": 2, "a_2": "q", "a_1": 4} and ("clash", 1) not in got
    assert got["dates", 3] == ({"Datum": "31.12.2024", "Preis": 1.5, "_c2": 7, "Text": ""}, None)
    assert got["dates", 5] == ({"Datum": "nie", "Preis": 2.0}, None) and ("dates", 6) not in got
    assert {k for k in got if k[0] == "bare"} <= {("bare", 1), ("bare", 2)}
    plans = spark.createDataFrame([("dates", ["day", "price"], ["date", "integer"])], "path string, names array<string>, types array<string>")
    rows = {r["line_no"]: (r["row"].toPython(), r["_rescued"]) for r in typed_rows(with_profile(lines, profile), plans).collect()}
    assert rows[3] == ({"day": dt.datetime(2024, 12, 31)}, {1: "1.5", 2: "7", 3: '""'})
    assert rows[5] == ({"price": 2}, {0: "nie"}) and typed_rows(with_profile(lines, profile).limit(0), plans).count() == 0
