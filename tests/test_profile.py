import random
import re

from pyspark.sql import functions as F

from rowloom.operators.cells import (
    column_names, column_plan, column_types, to_cells, to_typed, with_profile, with_typed_fields,
)
from rowloom.operators.numbering import head_rows, number_rows
from rowloom.operators.profile import profile_files
from rowloom.sources.tables import text_lines

SEMICOLONS = 'test1;test2;test3\n"hal|lo";434;45.66\n"hall|o";434;45.66\n"ha,llo";434;45.66\n"hallo";545.4;6\n'
PIPES = 'test1|test2|test3\n"hal|lo"|434|45.66\n"halßlo"|434|45.66\n"hallo"|434|45.66\n"haöllo"|545.4|6\n'


def lines_of(spark, **texts):
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    return text_lines(df, F.col("path"), F.col("text"))


def profiles(spark, texts, **options):
    return {r["path"]: r for r in profile_files(lines_of(spark, **texts), **options).collect()}


def test_samples(spark):
    found = profiles(spark, {"a": SEMICOLONS, "b": PIPES})
    a, b = found["a"], found["b"]
    assert (a["separator"], a["separator_probability"]) == (";", 10 / 13 * 100)
    assert (b["separator"], b["separator_probability"]) == ("|", 100.0)
    for p in (a, b):
        assert (p["start_line"], p["end_line"], p["analyzed_lines"], p["total_lines"]) == (1, 5, 5, 5)
        assert (p["field_count"], p["is_field_count_equal"], p["has_header"]) == (3, True, True)
        assert p["header_names"] == ["test1", "test2", "test3"]


def test_edges(spark):
    texts = {
        "blanks": "\n  \n\t\na;b\n1;2\n",
        "ragged": "id;name;x\n1;2\n",
        "words": "one\ntwo\nthree\n",
        "numbers": "1;2\n3;4\n",
        "known": "id;2\n3;4\n",
        "single": "id;name\n",
        "empty_lines": "\n\n",
        "tie": "a,b;c\nd,e;f\n",
        "gap": "a;b\n\n1;2\n",
        "lenient": "1,000\t(5)\n2\t3-\n",
        "long": "a;b\n" * 100 + "x,y,z,w\n" * 50,
    }
    p = profiles(spark, texts)
    assert p["blanks"]["start_line"] == 4 and p["blanks"]["separator"] == ";"
    assert p["ragged"]["has_header"] is False and p["ragged"]["is_field_count_equal"] is False
    assert (p["words"]["separator"], p["words"]["separator_probability"], p["words"]["field_count"]) == ("", 0.0, 1)
    assert p["words"]["has_header"] is True
    assert p["numbers"]["has_header"] is False and p["numbers"]["header_names"] is None
    assert p["known"]["has_header"] is True
    assert p["single"]["has_header"] is False
    assert (p["empty_lines"]["start_line"], p["empty_lines"]["field_count"]) == (0, 0)
    assert p["tie"]["separator"] == ","
    assert p["gap"]["is_field_count_equal"] is False and p["gap"]["has_header"] is True
    assert p["lenient"]["separator"] == "\t" and p["lenient"]["has_header"] is False
    assert (p["long"]["separator"], p["long"]["analyzed_lines"], p["long"]["total_lines"]) == (";", 100, 150)


def test_given_options(spark):
    p = profiles(spark, {"a": "x:y\n1:2\n"}, separator=":", header=False)["a"]
    assert (p["separator"], p["separator_probability"], p["field_count"], p["has_header"]) == (":", 100.0, 2, False)
    r = profiles(spark, {"a": "x:y;z\n1:2,3\n"}, candidates=(":", "#"))["a"]
    assert (r["separator"], r["separator_probability"], r["field_count"]) == (":", 100.0, 2)
    q = profiles(spark, {"a": "1;2\n3;4\n"}, header=True, analyze_lines=1)["a"]
    assert q["header_names"] == ["1", "2"] and q["analyzed_lines"] == 1 and q["total_lines"] == 2


def test_cells(spark):
    lines = lines_of(spark, a=SEMICOLONS)
    cells = to_cells(with_profile(lines, profile_files(lines)))
    got = {r["ref"]: (r["kind"], r["text"], r["style"], r["quoted"]) for r in cells.collect()}
    assert got["A1"] == ("text", "test1", 0, False) and got["A2"] == ("text", "hal|lo", 0, True)
    assert got["B2"] == ("integer", "434", 3, False) and got["C5"] == ("integer", "6", 3, False)
    assert got["B5"] == ("decimal", "545.4", 2, False) and len(got) == 15
    types = {r["col"]: r["data_type"] for r in column_types(cells.filter("row > 1")).collect()}
    assert types == {0: "text", 1: "decimal", 2: "decimal"}


def test_rules_steer_cells(spark):
    lines = lines_of(spark, a="id;preis;datum\n007;5;2025-01-31\n8;x;20250131\n")
    settled = with_profile(lines, profile_files(lines))
    got = {r["ref"]: r["kind"] for r in to_cells(settled).collect()}
    assert [got[k] for k in ("A1", "A2", "B2", "C2", "B3", "C3")] == ["text", "text", "decimal", "date", "text", "text"]
    arrays = with_typed_fields(settled).select("line_no", F.posexplode("cells").alias("col", "c"))
    assert {(r["line_no"], r["col"]): r["c"]["kind"] for r in arrays.collect()} == {
        (int(k[1:]), ord(k[0]) - 65): v for k, v in got.items()}


def test_leading_blank_lines_are_dropped(spark):
    lines = lines_of(spark, a="\n\na;1\n\nb;2\n")
    cells = to_cells(with_profile(lines, profile_files(lines)))
    assert sorted(r["ref"] for r in cells.collect()) == ["A1", "A3", "B1", "B3"]


def test_typed_table(spark):
    lines = lines_of(spark, a='n;t;d;x\n1;a;2025-01-31;2,5\n;"";31.01.2025;zz\n2;b\n3;c;x;4;extra\n')
    plan = [("n", "integer"), ("t", "text"), ("d", "date"), ("x", "decimal")]
    rows = {r["line_no"]: r for r in to_typed(lines, plan, ";", has_header=True).collect()}
    assert (rows[2]["n"], rows[2]["t"], str(rows[2]["d"]), rows[2]["x"], rows[2]["_rescued"]) == (
        1, "a", "2025-01-31 00:00:00", 2.5, None)
    assert (rows[3]["n"], rows[3]["t"], rows[3]["_rescued"]) == (None, "", {"x": "zz"})
    assert (rows[4]["d"], rows[4]["_rescued"]) == (None, None)
    assert rows[5]["_rescued"] == {"d": "x", "_c4": "extra"}


def test_column_plan(spark):
    lines = lines_of(spark, a="1;x\n2;y\n")
    types = column_types(to_cells(with_profile(lines, profile_files(lines))))
    assert column_plan(types, "a", ["k", "k"]) == [("k", "integer"), ("k_1", "text")]


def test_numbering_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") * 7 + 3).alias("k"),
    )
    rows = number_rows(df, "g", F.col("k"), span=64).collect()
    assert len(rows) == 5000
    by_group = {}
    for r in rows:
        by_group.setdefault(r["g"], []).append((r["k"], r["line_no"]))
    for pairs in by_group.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))
    heads = head_rows(df, "g", [F.col("k")], 5).groupBy("g").count().collect()
    assert {r["count"] for r in heads} == {5}


def test_typing_stage_compiles(spark):
    """The generated code of a typing stage stays below the size the JVM compiles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(1).selectExpr(
            "'a' path", "id + 1 line_no", "cast(id as string) line", "if(id = 0, ';', ',') separator",
            "1L start_line", "cast(null as array<string>) overrides")
        stages = to_cells(lines)._jdf.queryExecution().debug().codegenToSeq()
        assert stages.size() >= 1
        assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_column_names_differ_without_regard_to_case():
    assert column_names(["a", "a", "a_1"], 3) == ["a", "a_2", "a_1"]
    assert column_names(["ID", "id", "Id"], 3) == ["ID", "id_1", "Id_2"]
    assert column_names(["path", "Line_No", "_rescued", "x"], 4) == ["path_1", "Line_No_1", "_rescued_1", "x"]
    assert column_names(["_c2", "", "y"], 4) == ["_c2_1", "_c1", "y", "_c3"]
    for seed in range(200):
        rng = random.Random(seed)
        names = [rng.choice(["a", "A", "a_1", "A_1", "a_2", "", "_c1", "_C3", "path"]) for _ in range(rng.randrange(12))]
        made = [n.lower() for n in column_names(names, 12)]
        assert len(set(made)) == 12 and not {"path", "line_no", "_rescued"} & set(made)
        assert all(n == f"_c{i}" for i, n in enumerate(made) if re.fullmatch(r"_c[0-9]+", n))


def test_typed_table_of_clashing_names(spark):
    lines = spark.createDataFrame([("f", 1, "ID;id;a;a;a_1"), ("f", 2, "1;x;2;3;4;5"), ("f", 3, "y;x;2;q;4")], "path string, line_no long, line string")
    columns = list(zip(column_names(["ID", "id", "a", "a", "a_1"], 5), ["integer", "text", "integer", "integer", "integer"]))
    rows = to_typed(lines, columns, ";", True).orderBy("line_no").collect()
    assert rows[0].asDict() == {"path": "f", "line_no": 2, "ID": 1, "id_1": "x", "a": 2, "a_2": 3, "a_1": 4, "_rescued": {"_c5": "5"}}
    assert rows[1]["_rescued"] == {"ID": "y", "a_2": "q"}
