"""Field-name rules: which names belong to a header, and which type a name asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.split import trim_space
from rowloom.session import checked_broadcast, materialize

# ---------------------------------------------------------------------------------------
# Fixed values. Patterns of the default rule set, in order; matched anywhere in the trimmed
# lower-case name. Names that mark a header line: regular expressions and plain texts.
DEFAULT_HEADER_PATTERNS = [
    (".*id.*", True),
    (".*nr.*", True),
    (".*no.*", True),
    (".*nummer.*", True),
    (".*number.*", True),
    ("artikel", False),
    ("article", False),
    ("produkt", False),
    ("product", False),
    ("part", False),
    ("teilnummer", False),
    ("partno", False),
    ("part-no", False),
    ("sku", False),
    ("name", False),
    ("bezeichnung", False),
    ("description", False),
    ("titel", False),
    ("title", False),
    ("preis", False),
    ("price", False),
    ("betrag", False),
    ("amount", False),
    ("kosten", False),
    ("cost", False),
    ("datum", False),
    ("date", False),
    ("^von$", True),
    ("^bis$", True),
    ("^from$", True),
    ("^to$", True),
    ("strasse", False),
    ("street", False),
    ("ort", False),
    ("city", False),
    ("plz", False),
    ("postleitzahl", False),
    ("zip", False),
    ("postal", False),
    ("email", False),
    ("e-mail", False),
    ("mail", False),
    ("telefon", False),
    ("phone", False),
    ("tel", False),
    ("menge", False),
    ("quantity", False),
    ("anzahl", False),
    ("count", False),
    ("qty", False),
]

# Fixed values. Type a name asks for, the first match wins.
DEFAULT_TYPE_OVERRIDES = [
    ("^id$", True, "Text"),
    (".*id$", True, "Text"),
    ("kundennummer", False, "Text"),
    ("customerno", False, "Text"),
    ("matnr", False, "Text"),
    ("part", False, "Text"),
    ("artikel", False, "Text"),
    ("preis", False, "Decimal"),
    ("price", False, "Decimal"),
    ("betrag", False, "Decimal"),
    ("amount", False, "Decimal"),
    ("menge", False, "Integer"),
    ("quantity", False, "Integer"),
    ("anzahl", False, "Integer"),
    ("qty", False, "Integer"),
    ("datum", False, "Date"),
    ("date", False, "Date"),
    ("geburtsdatum", False, "Date"),
    ("birthdate", False, "Date"),
    ("plz", False, "Text"),
    ("postleitzahl", False, "Text"),
    ("zip", False, "Text"),
]
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Ordered header patterns ``(pattern, is_regex)`` and overrides ``(pattern, is_regex, type)``."""

    header_patterns: list[tuple[str, bool]] = field(default_factory=lambda: list(DEFAULT_HEADER_PATTERNS))
    type_overrides: list[tuple[str, bool, str]] = field(default_factory=lambda: list(DEFAULT_TYPE_OVERRIDES))

    def override_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p, r, t) for i, (p, r, t) in enumerate(self.type_overrides)]
        return spark.createDataFrame(rows, "priority int, pattern string, is_regex boolean, data_type string")


DEFAULT_RULES = Rules()


def _core(pattern: str) -> str:
    """A pattern to search for without the ``.*`` at its ends, which a search does not need.

    Kept, they make a search that fails quadratic in the length of the name.
    """
    if pattern.startswith(".*") and not pattern[2:3] in ("?", "+", "*", "{"):
        pattern = pattern[2:]
    if pattern.endswith(".*") and not pattern.endswith("\\.*"):
        pattern = pattern[:-2]
    return pattern


def _matches(name: Column, pattern: str, is_regex: bool) -> Column:
    """Does the pattern occur in the lower-case name?"""
    core = _core(pattern) if is_regex else pattern
    if not is_regex or core.isalnum():
        return name.contains(core.lower())
    return name.rlike("(?iu)" + core)


def _joinable(rules: Rules) -> tuple[list[str], list[tuple[str, bool]]]:
    """Header patterns fit to be alternatives of one regex, and the others.

    Letters, digits and anchors mean the same there; groups and flags might not.
    """
    plain, others = [], []
    for pattern, is_regex in rules.header_patterns:
        core = _core(pattern) if is_regex else pattern.lower()
        fit = re.fullmatch(r"\^?[\w -]+\$?" if is_regex else r"[\w -]+", core)
        plain.append(core) if fit else others.append((pattern, is_regex))
    return plain, others


def _key(name: Column) -> Column:
    return F.lower(trim_space(F.coalesce(name, F.lit(""))))


def is_header_name(name: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Does any header pattern occur in the name?"""

    plain, others = _joinable(rules)

    def any_pattern(key: Column) -> Column:
        hit = key.rlike("(?iu)" + "|".join(plain)) if plain else F.lit(False)
        for pattern, is_regex in others:
            hit = hit | _matches(key, pattern, is_regex)
        return (key != "") & hit

    # The one-element array has the key worked out once for all patterns.
    return F.exists(F.array(_key(name)), any_pattern)


def override_of(name: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Type the first matching rule asks for, else ``Auto``."""

    def first_rule(key: Column) -> Column:
        chain = F.when(key == "", "Auto")
        for pattern, is_regex, data_type in rules.type_overrides:
            chain = chain.when(_matches(key, pattern, is_regex), data_type)
        return chain.otherwise("Auto")

    return F.get(F.transform(F.array(_key(name)), first_rule), F.lit(0))


def overrides_of_names(spark: SparkSession, names: list[str], rules: Rules = DEFAULT_RULES) -> list[str]:
    """:func:`override_of` for the known column names of one table, worked out once."""
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    found = rows.select("i", override_of(F.col("name"), rules).alias("o")).collect()
    return [r["o"] for r in sorted(found)]


# Letters of the pieces by which patterns of a rule table find names.
GRAM = 3


def required_text(pattern: str, is_regex: bool) -> str:
    """The longest text that every name matching a pattern holds, in lower case, as far as it is plain to see.

    Only ASCII letters, digits, blanks, ``_`` and ``-`` count, whose case all matches agree on. Alternatives, groups, and
    what a quantifier follows are passed over.
    """
    if not is_regex:
        parts = re.split(r"[^A-Za-z0-9 _-]", pattern)
    else:
        escaped = re.findall(r"(?s)\\(.)", pattern)
        if re.search(r"[|()]", pattern) or any(c.isalnum() and c not in "dDwWsSbB" for c in escaped):
            return ""
        plain = re.sub(r"\[\^?\]?[^\[\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
        if "[" in plain or "]" in plain:
            return ""
        plain = re.sub(r".(?:[*?+]|\{[^}]*\})+", "\0", plain)
        parts = re.split(r"[^A-Za-z0-9 _-]", plain)
    return max(parts, key=len, default="").lower()


def _folded(text: Column) -> Column:
    """Lower case, with the letters beyond ASCII that a search without regard to case takes for ASCII ones as these."""
    return F.translate(F.lower(text), "\u017f\u0131\u212a", "sik")


def _grams(text: Column) -> Column:
    """The different pieces of :data:`GRAM` letters of a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def resolve_overrides(names: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Names joined with a table of rules: ``data_type`` of the matching rule of least priority.

    For rule sets that live in a table, of any number; ``override_of`` is the cheaper form for a rule list. A pattern
    with a text of three letters that any match must hold is indexed by the piece of it that the fewest names hold: an
    equi-join of that piece with the pieces of the names proposes the pairs that are matched. Patterns without such a
    text are tried on all names; they are measured before they are broadcast.
    """
    key = _key(F.col(name))
    hit = F.when(F.col("is_regex"), F.expr("_key rlike concat('(?iu)', pattern)")).otherwise(
        F.col("_key").contains(F.lower("pattern"))
    )

    @F.pandas_udf("string")
    def required(pattern: pd.Series, is_regex: pd.Series) -> pd.Series:
        return pd.Series([required_text(p or "", bool(r)) for p, r in zip(pattern, is_regex)])

    ruled = materialize(rules.withColumn("_rule", F.monotonically_increasing_id()).withColumn(
        "_text", required(F.col("pattern"), F.col("is_regex"))))
    distinct = materialize(names.select(name).distinct().withColumn("_key", key))
    indexed, others = ruled.filter(F.length("_text") >= GRAM), ruled.filter(F.length("_text") < GRAM)
    spread = distinct.filter(F.col("_key") != "").select(name, "_key", F.explode(_grams(_folded(F.col("_key")))).alias("_gram"))
    asked = indexed.select("_rule", F.explode(_grams(F.col("_text"))).alias("_gram"))
    wanted = checked_broadcast(materialize(asked.select("_gram").distinct()))
    # names that hold no piece of any pattern go no further
    held = spread.join(wanted, "_gram", "left_semi")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(often, "_gram", "left").groupBy("_rule").agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    by_gram = checked_broadcast(materialize(indexed.join(rarest, "_rule")))
    proposed = held.join(by_gram, "_gram").filter(hit).select(name, "data_type", "priority")
    tried = distinct.join(checked_broadcast(others), (F.col("_key") != "") & hit).select(name, "data_type", "priority")
    first = proposed.unionByName(tried).groupBy(name).agg(F.min_by("data_type", "priority").alias("data_type"))
    found = distinct.select(name).join(first.withColumnRenamed(name, "_name"), F.col(name).eqNullSafe(F.col("_name")), "left")
    return found.select(name, F.coalesce("data_type", F.lit("Auto")).alias("data_type"))


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules from an XML file; the default rules if it is missing or cannot be read.

    Patterns Spark cannot compile are left out, as they can never match.
    """
    schema = (
        "HeaderFieldNames struct<Field array<struct<_Pattern string, _IsRegex boolean>>>, "
        "DataTypeOverrides struct<Override array<struct<"
        "_FieldNamePattern string, _IsRegex boolean, _DataType string>>>"
    )
    try:
        # A rule file is written by hand; its one row is read to the driver.
        text = spark.read.text(path, wholetext=True)
        row = text.select(F.from_xml("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*").first()
    except Exception:
        return DEFAULT_RULES
    if row is None:
        return DEFAULT_RULES
    headers = (row["HeaderFieldNames"]["Field"] if row["HeaderFieldNames"] else None) or []
    overrides = (row["DataTypeOverrides"]["Override"] if row["DataTypeOverrides"] else None) or []
    return valid_rules(
        spark,
        Rules(
            [(h["_Pattern"] or "", bool(h["_IsRegex"])) for h in headers],
            [(o["_FieldNamePattern"] or "", bool(o["_IsRegex"]), o["_DataType"] or "Text") for o in overrides],
        ),
    )


def valid_rules(spark: SparkSession, rules: Rules) -> Rules:
    """The rules whose patterns compile."""

    def compiles(pattern: str, is_regex: bool) -> bool:
        if not is_regex:
            return True
        try:
            spark.range(1).select(F.lit("x").rlike("(?iu)" + pattern)).first()
            return True
        except Exception:
            return False

    return Rules(
        [h for h in rules.header_patterns if compiles(*h)],
        [o for o in rules.type_overrides if compiles(o[0], o[1])],
    )
