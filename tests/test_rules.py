from rowloom.rules import (
    DEFAULT_RULES, Rules, is_header_name, load_rules, override_of, overrides_of_names, resolve_overrides, valid_rules,
)

NAMES = {
    "id": (True, "Text"), "name": (True, "Auto"), "preis": (True, "Decimal"), "datum": (True, "Date"),
    "xyz123": (False, "Auto"), "kundennummer": (True, "Text"), "menge": (True, "Integer"), "plz": (True, "Text"),
    "department": (True, "Text"), "update": (True, "Date"), "geburtsdatum": (True, "Date"), " ID ": (True, "Text"),
    "p_retailprice": (True, "Decimal"), "o_orderdate": (True, "Date"), "c_custkey": (False, "Auto"),
    "l_quantity": (True, "Integer"), "": (False, "Auto"), "FROM": (True, "Auto"), "fromage": (False, "Auto"),
}


def test_default_rules(spark, values):
    assert len(DEFAULT_RULES.header_patterns) == 50 and len(DEFAULT_RULES.type_overrides) == 22
    assert values(is_header_name, list(NAMES)) == [h for h, _ in NAMES.values()]
    assert values(override_of, list(NAMES)) == [t for _, t in NAMES.values()]
    assert overrides_of_names(spark, list(NAMES)) == [t for _, t in NAMES.values()]


def test_rules_in_a_table(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = resolve_overrides(names, DEFAULT_RULES.override_table(spark)).collect()
    assert {r["name"]: r["data_type"] for r in got} == {n: t for n, (_, t) in NAMES.items()}


def test_pattern_ends(values):
    rules = Rules([(r"a\.*", True), (".*?b$", True), (".*c.*", True)], [])
    assert values(lambda v: is_header_name(v, rules), ["xa", "xb", "bx", "xcx", "d"]) == [True, True, False, True, False]


def test_bad_patterns_are_left_out(spark, values):
    rules = valid_rules(spark, Rules([("(", True), ("ok", False)], [("[", True, "Text"), ("x", True, "Date")]))
    assert rules.header_patterns == [("ok", False)] and rules.type_overrides == [("x", True, "Date")]


def test_load_rules(spark, tmp_path):
    path = tmp_path / "rules.xml"
    path.write_text(
        '<?xml version="1.0" encoding="utf-8"?><Config><!-- names -->'
        '<HeaderFieldNames><Field Pattern="^nr$" IsRegex="true" /><Field Pattern="ort" IsRegex="false" />'
        '</HeaderFieldNames><DataTypeOverrides>'
        '<Override FieldNamePattern="preis" IsRegex="false" DataType="Decimal" /></DataTypeOverrides></Config>'
    )
    rules = load_rules(spark, str(path))
    assert rules.header_patterns == [("^nr$", True), ("ort", False)]
    assert rules.type_overrides == [("preis", False, "Decimal")]
    assert load_rules(spark, str(tmp_path / "none.xml")) == DEFAULT_RULES
    (tmp_path / "bad.xml").write_text("not xml <")
    assert load_rules(spark, str(tmp_path / "bad.xml")) == DEFAULT_RULES
