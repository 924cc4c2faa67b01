"""The registered queries: each operator at work over whole tables."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.cells import style_format
from rowloom.functions.dates import date_serial, parse_date, serial_text
from rowloom.functions.numbers import (
    export_number,
    is_integral,
    number_text,
    parse_lenient_number,
    parse_number,
    strict_integer,
)
from rowloom.functions.refs import (
    cell_ref,
    column_letters,
    output_path,
    path_base,
    path_extension,
    ref_column,
    safe_sheet_name,
    sheet_path,
)
from rowloom.functions.split import field_quoted, field_value, is_blank, line_array, raw_fields, split_fields
from rowloom.operators.cells import (
    column_types,
    to_cells,
    to_typed,
    type_fields,
    with_profile,
    with_typed_fields,
)
from rowloom.operators.densify import densify, render_lines
from rowloom.operators.numbering import number_rows
from rowloom.operators.variants import typed_sources
from rowloom.operators.profile import ANALYZE_LINES, profile_files, profile_heads
from rowloom.rules import (
    DEFAULT_RULES, Rules, is_header_name, load_rules, override_of, overrides_of_names, resolve_overrides,
)
from rowloom.session import materialize, scratch_path
from rowloom.sinks.naming import free_names
from rowloom.sinks.workbooks import export_workbooks
from rowloom.sources.tables import print_line, print_value, table_head, table_lines
from rowloom.sources.text_files import explode_lines
from rowloom.sources.workbooks import PART_SCHEMA, resolve_cells, sheet_styles, workbook_cells

# Tables printed as delimited text: separator and key of each.
PRINTED = {
    "orders": (";", "o_orderkey"),
    "customer": ("|", "c_custkey"),
    "part": (",", "p_partkey"),
    "supplier": ("\t", "s_suppkey"),
}

PROFILE_REPORT = (
    "path",
    "separator",
    "separator_probability",
    "start_line",
    "end_line",
    "analyzed_lines",
    "total_lines",
    "field_count",
    "is_field_count_equal",
    "has_header",
)


# Checksums are taken modulo this number, so that a group of any size fits a whole number.
CHECKSUM_MODULUS = 1 << 61


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, as text work is bound by the processor.

    Does nothing for a table with enough splits of its own, as any large one has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checksum(value: Column) -> Column:
    """Sum over a group that changes with any value in it, in whatever order."""
    total = F.sum(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("decimal(20,0)"))
    return (total % F.lit(CHECKSUM_MODULUS)).cast("bigint")


def joined(names: Column) -> Column:
    return F.coalesce(F.array_join(names, "|"), F.lit(""))


def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source: all its lines and the head that is analyzed. No shuffle."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), line_array(F.col("text")).alias("lines")
    )
    return docs.withColumn("head", F.slice("lines", 1, ANALYZE_LINES)).withColumn("total", F.size("lines"))


# --- profiling ---------------------------------------------------------------------------


def separator_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables printed with four separators, profiled by their first lines."""
    heads, totals = None, None
    for name, (sep, key) in PRINTED.items():
        df = table(spark, sf_dir, name)
        head = table_head(df, F.lit(name), F.col(key), df.columns, sep, ANALYZE_LINES)
        total = df.agg(F.count(F.lit(1)).alias("total_lines")).select(F.lit(name).alias("path"), "total_lines")
        heads = head if heads is None else heads.unionByName(head)
        totals = total if totals is None else totals.unionByName(total)
    return profile_files(heads, totals=totals).select(*PROFILE_REPORT)


def document_line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document profiled as a source of its own."""
    profiled = profile_heads(document_heads(spark, sf_dir), "head", "total")
    return profiled.select(*PROFILE_REPORT, joined(F.col("header_names")).alias("header_names"))


def full_line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document profiled by all of its lines, of which none are gathered."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), line_array(F.col("text")).alias("lines"))
    profiled = profile_files(materialize(explode_lines(docs)), analyze_lines=None)
    return profiled.select(*PROFILE_REPORT, joined(F.col("header_names")).alias("header_names"))


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header decision, names and types asked for, of each conversation turn as a source."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
        line_array(F.col("text")).alias("lines"),
    )
    heads = turns.withColumn("head", F.slice("lines", 1, ANALYZE_LINES))
    profiled = profile_heads(heads, "head")
    return profiled.select(
        "path",
        "has_header",
        joined(F.col("header_names")).alias("header_names"),
        joined(F.col("overrides")).alias("overrides"),
    )


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and blank lines of each document, with the first and second content line."""
    lines = explode_lines(document_heads(spark, sf_dir).select("path", "lines"))
    content = F.when(~is_blank(F.col("line")), F.col("line_no"))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(content).alias("content_lines"),
        F.min(content).alias("first_content"),
        F.max(content).alias("last_content"),
    )


def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered within their type."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    return number_rows(events, "event_type", F.col("event_id")).select(
        "event_type", "event_id", F.col("line_no").cast("bigint").alias("line_no")
    )


# --- splitting ---------------------------------------------------------------------------


def field_count_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field counts of events printed bare and fully quoted."""
    events = table(spark, sf_dir, "events")
    counts = None
    for name, mode in (("bare", 0), ("quoted", 2)):
        lines = events.select(print_line(events, events.columns, ";", mode).alias("line"))
        part = lines.select(F.lit(name).alias("path"), raw_fields(F.col("line"), ";").alias("fields"))
        counts = part if counts is None else counts.unionByName(part)
    sized = counts.select(
        "path",
        F.size("fields").alias("n"),
        F.size(F.filter("fields", field_quoted)).alias("q"),
    )
    return sized.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        (F.min("n") == F.max("n")).alias("is_field_count_equal"),
        F.sum("q").alias("quoted_fields"),
    )


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document split at the separator found for the document."""
    profiled = profile_heads(document_heads(spark, sf_dir), "head", "total")
    lines = explode_lines(profiled.select("path", "lines", "separator"))
    fields = lines.select("path", F.explode(raw_fields(F.col("line"), F.col("separator"))).alias("raw"))
    return fields.groupBy("path").agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(field_quoted(F.col("raw"))).alias("quoted_fields"),
        F.sum(F.length(field_value(F.col("raw")))).alias("chars"),
        checksum(field_value(F.col("raw"))).alias("checksum"),
    )


def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered under quote modes 1 and 2 and split again."""
    events = table(spark, sf_dir, "events")
    out = None
    for mode in (1, 2):
        lines = events.select(print_line(events, events.columns, ",", mode).alias("line"))
        fields = lines.select(F.lit(mode).alias("mode"), split_fields(F.col("line"), ",").alias("f"))
        part = fields.select(
            "mode", *[F.get("f", F.lit(i))["value"].alias(c) for i, c in enumerate(events.columns)]
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- typing ------------------------------------------------------------------------------


def _printed_fields(df: DataFrame, name: str, sep: str) -> DataFrame:
    """Raw fields of a printed table, one per row."""
    lines = df.select(print_line(df, df.columns, sep).alias("line"))
    return lines.select(F.lit(name).alias("path"), F.posexplode(raw_fields(F.col("line"), sep)).alias("col", "_raw"))


TYPE_REPORT = ("path", "col", "cells", "empty", "texts", "integers", "decimals", "dates", "data_type")


def cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all cells of lineitem printed as text, rolled up per column."""
    lineitem = table(spark, sf_dir, "lineitem")
    typed = type_fields(_printed_fields(lineitem, "lineitem", ";"), F.col("_raw"), F.lit(None).cast("string"))
    return column_types(typed).select(*TYPE_REPORT)


def override_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the types that the names of the columns ask for."""
    lineitem = table(spark, sf_dir, "lineitem")
    overrides = F.array(*[F.lit(o) for o in overrides_of_names(spark, lineitem.columns)])
    fields = _printed_fields(lineitem, "lineitem", ";")
    typed = type_fields(fields, F.col("_raw"), F.get(overrides, F.col("col")))
    return column_types(typed).select(*TYPE_REPORT)


def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From printed lines with a header line to a type per column: profile, split, type, roll up."""
    orders = table(spark, sf_dir, "orders")
    sep, key = PRINTED["orders"]
    columns = orders.columns
    names = spark.range(1).select(
        F.lit("orders").alias("path"), F.lit(1).cast("bigint").alias("line_no"), F.lit(sep.join(columns)).alias("line")
    )

    def below_header(lines: DataFrame) -> DataFrame:
        return names.unionByName(lines.withColumn("line_no", F.col("line_no") + 1))

    head = below_header(table_head(orders, F.lit("orders"), F.col(key), columns, sep, ANALYZE_LINES))
    totals = orders.agg((F.count(F.lit(1)) + 1).alias("total_lines")).select(F.lit("orders").alias("path"), "total_lines")
    profile = materialize(profile_files(head, totals=totals))
    lines = below_header(table_lines(orders, F.lit("orders"), F.col(key), columns, sep))
    cells = to_cells(with_profile(lines, profile, measured=True))
    values = cells.filter(F.col("row") > 1)
    named = column_types(values).join(F.broadcast(_column_names(profile)), ["path", "col"])
    return named.select("name", *TYPE_REPORT)


def unlike_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of different columns printed with header lines, found out, and read as one table of typed rows."""
    printed = None
    for name, (sep, key) in PRINTED.items():
        df = table(spark, sf_dir, name)
        lines = table_lines(df, F.lit(name), F.col(key), df.columns, sep).withColumn("line_no", F.col("line_no") + 1)
        header = spark.range(1).select(F.lit(name).alias("path"), F.lit(1).cast("bigint").alias("line_no"), F.lit(sep.join(df.columns)).alias("line"))
        printed = lines.unionByName(header) if printed is None else printed.unionByName(lines).unionByName(header)
    printed = materialize(printed)
    profile = materialize(profile_files(printed, header=True))
    typed = typed_sources(with_profile(printed, profile, measured=True), profile)

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("row", f"$.{name}", kind)

    amount = F.coalesce(*[field(c, "double") for c in ("o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal")])
    key = F.coalesce(*[field(c, "bigint") for c in ("o_orderkey", "c_custkey", "p_partkey", "s_suppkey")])
    return typed.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(key).alias("keys"),
        F.sum(F.round(amount * 100).cast("bigint")).alias("cents"),
        F.sum(F.date_diff(field("o_orderdate", "timestamp_ntz").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")).alias("days"),
        checksum(F.coalesce(*[field(c, "string") for c in ("o_orderpriority", "c_name", "p_name", "s_name")])).alias("names"),
        F.count("_rescued").alias("rescued"),
    )


def _column_names(profile: DataFrame) -> DataFrame:
    """Header names of the one printed source, by position: as many rows as it has columns."""
    return profile.select("path", F.posexplode("header_names").alias("col", "name"))


def column_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type per column of several printed tables."""
    fields = None
    for name, (sep, _) in PRINTED.items():
        part = _printed_fields(table(spark, sf_dir, name), name, sep)
        fields = part if fields is None else fields.unionByName(part)
    typed = type_fields(fields, F.col("_raw"), F.lit(None).cast("string"))
    return column_types(typed).select(*TYPE_REPORT, F.round("null_rate", 6).alias("null_rate"))


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: profile, split and type every line, kinds per document."""
    profiled = profile_heads(document_heads(spark, sf_dir), "head", "total")
    lines = explode_lines(profiled.select("path", "lines", "separator", "start_line", "overrides"))
    cells = to_cells(lines)
    return cells.groupBy("path").agg(
        F.max("row").alias("last_row"),
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("kind") == "text").alias("texts"),
        F.count_if(F.col("kind") == "integer").alias("integers"),
        F.count_if(F.col("kind") == "decimal").alias("decimals"),
        F.count_if(F.col("kind") == "date").alias("dates"),
        checksum(F.concat_ws(":", "ref", "style", "text")).alias("checksum"),
    )


def typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers printed as text and read back as typed columns."""
    customer = table(spark, sf_dir, "customer")
    sep, key = PRINTED["customer"]
    lines = table_lines(customer, F.lit("customer"), F.col(key), customer.columns, sep)
    types = ["integer", "text", "integer", "decimal", "text"]
    typed = to_typed(lines, list(zip(customer.columns, types)), sep)
    return typed.select(*customer.columns, F.col("_rescued").isNull().alias("complete"))


def name_rules(spark: SparkSession, sf_dir: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Words of all documents looked up as field names."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("name"))
    counted = words.filter(F.col("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    ruled = counted.withColumn("is_header", is_header_name(F.col("name"), rules)).withColumn(
        "data_type", override_of(F.col("name"), rules)
    )
    return ruled.groupBy("data_type", "is_header").agg(
        F.count(F.lit(1)).alias("names"), F.sum("n").alias("words"), checksum(F.col("name")).alias("checksum")
    )


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of :func:`name_rules` by a rule file: the default rules written as XML and loaded."""
    def element(name: str, **values: object) -> str:
        return f"<{name} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in values.items()) + "/>"

    fields = [element("Field", Pattern=p, IsRegex=str(r).lower()) for p, r in DEFAULT_RULES.header_patterns]
    overrides = [element("Override", FieldNamePattern=p, IsRegex=str(r).lower(), DataType=t) for p, r, t in DEFAULT_RULES.type_overrides]
    text = f"<Rules><HeaderFieldNames>{''.join(fields)}</HeaderFieldNames><DataTypeOverrides>{''.join(overrides)}</DataTypeOverrides></Rules>"
    target = scratch_path(spark, "rules")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(target)
    return name_rules(spark, sf_dir, load_rules(spark, target))


def rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words joined with a table of rules, the first rule wins."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"\s+")).alias("name"))
    rules = DEFAULT_RULES.override_table(spark)
    return resolve_overrides(words.filter(F.col("name") != ""), rules)


# --- values ------------------------------------------------------------------------------


def german_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed with a decimal comma, parsed, and written in export and stored form."""
    lineitem = table(spark, sf_dir, "lineitem")
    printed = F.translate(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), ".", ",")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    parsed = lineitem.select("l_returnflag", parse_number(printed).alias("price"), charge.alias("charge"))
    return parsed.groupBy("l_returnflag").agg(
        F.count("price").alias("prices"),
        F.count_if(is_integral(F.col("price"))).alias("whole"),
        F.sum(F.col("price").cast("decimal(18,2)")).alias("total"),
        checksum(export_number(F.col("price"))).alias("exported"),
        checksum(number_text(F.col("price"))).alias("stored"),
        checksum(export_number(F.col("charge"))).alias("charges"),
    )


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices in six notations, and whether a strict or a lenient reader takes them."""
    part = table(spark, sf_dir, "part")
    plain = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    thousands = F.regexp_replace(plain, r"([0-9])([0-9]{3}\.)", "$1,$2")
    notation = F.pmod("p_partkey", F.lit(6))
    text = (
        F.when(notation == 0, plain)
        .when(notation == 1, thousands)
        .when(notation == 2, F.concat(F.lit("("), plain, F.lit(")")))
        .when(notation == 3, F.concat(plain, F.lit("-")))
        .when(notation == 4, F.concat(F.lit(" ¤"), plain, F.lit(" ")))
        .otherwise(F.concat(plain, F.lit("e1")))
    )
    shown = part.select("p_partkey", text.alias("text"))
    return shown.select(
        "p_partkey",
        "text",
        parse_lenient_number(F.col("text")).alias("lenient"),
        parse_number(F.col("text")).alias("strict"),
        strict_integer(parse_number(F.col("text"))).alias("as_integer"),
    )


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in three notations, parsed, as serial and back."""
    orders = table(spark, sf_dir, "orders")
    notation = F.pmod("o_orderkey", F.lit(3))
    text = (
        F.when(notation == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(notation == 1, F.date_format("o_orderdate", "d.M.yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    )
    fields = orders.select("o_orderkey", text.alias("_raw"))
    typed = type_fields(fields, F.col("_raw"), F.lit(None).cast("string"))
    american = parse_date(F.col("text"), "mdy")
    return typed.select(
        "o_orderkey",
        "text",
        "kind",
        date_serial(F.col("dt")).alias("serial"),
        serial_text(date_serial(F.col("dt"))).alias("back"),
        F.date_format(american, "yyyy-MM-dd").alias("month_first"),
        style_format(F.col("style")).alias("format"),
    )


def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as day serials, and the days they stand for."""
    events = table(spark, sf_dir, "events").select("event_id", date_serial(F.col("ts")).alias("serial"))
    return events.select("event_id", "serial", serial_text(F.col("serial")).alias("day"))


def quote_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered under the three quoting policies with two separators."""
    events = table(spark, sf_dir, "events")
    out = None
    for sep in (";", ","):
        for mode in (0, 1, 2):
            part = events.select(
                "event_id",
                F.lit(sep).alias("separator"),
                F.lit(mode).alias("mode"),
                print_line(events, ["event_type", "value", "props"], sep, mode).alias("line"),
            )
            out = part if out is None else out.unionByName(part)
    return out


# --- cells, sheets, names ----------------------------------------------------------------


def cell_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell references from positions and back."""
    lineitem = table(spark, sf_dir, "lineitem")
    col = F.pmod(F.col("l_partkey") * 8 + F.col("l_linenumber"), F.lit(16384)).cast("int")
    placed = lineitem.select(col.alias("col"), (F.col("l_suppkey") + 1).alias("row")).distinct()
    ref = placed.select("col", "row", column_letters(F.col("col")).alias("letters"),
                        cell_ref(F.col("col"), F.col("row")).alias("ref"))
    return ref.select("col", "row", "letters", "ref", ref_column(F.col("ref")).alias("back"))


def densify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sparse cells, without what says nothing, made full rows and rendered."""
    orders = table(spark, sf_dir, "orders")
    kinds = {"o_totalprice": "number", "o_orderdate": "date", "o_orderkey": "number", "o_custkey": "number"}
    absent = {
        "o_totalprice": F.col("o_totalprice") < 100000,
        "o_orderdate": F.col("o_orderstatus") == "F",
        "o_orderpriority": F.col("o_orderpriority") == "4-NOT SPECIFIED",
    }
    cells = F.array(
        *[
            F.when(
                ~absent.get(c, F.lit(False)),
                F.struct(
                    F.lit(i).alias("col"),
                    F.lit(i).alias("pos"),
                    F.lit(kinds.get(c, "text")).alias("kind"),
                    print_value(orders, c).alias("text"),
                ),
            )
            for i, c in enumerate(orders.columns)
        ]
    )
    sparse = orders.select(
        F.col("o_orderstatus").alias("path"), F.lit("Tabelle1").alias("sheet"),
        F.col("o_orderkey").alias("row"), F.explode(F.array_compact(cells)).alias("c"),
    ).select("path", "sheet", "row", "c.*")
    return render_lines(densify(sparse), ";", 1).select("path", "row", "line")


def shared_string_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored cells, resolved through shared strings, sheets and number formats."""
    orders = table(spark, sf_dir, "orders")
    # Five priorities by definition of the table: a small dictionary with dense numbers.
    words = orders.select("o_orderpriority").distinct()
    strings = words.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("w")).select(
        F.lit("orders.xlsx").alias("path"), F.posexplode("w").alias("idx", "shared")
    ).withColumn("idx", F.col("idx").cast("bigint"))
    dictionary = F.broadcast(strings.select("idx", F.col("shared").alias("o_orderpriority")))
    coded = orders.join(dictionary, "o_orderpriority")

    def cell(s: int, t: str | None, v: Column) -> Column:
        return F.struct(
            F.lit(s).alias("s"), F.lit(t).cast("string").alias("t"), v.cast("string").alias("v")
        )

    large = F.when(F.col("o_totalprice") > 250000, "1").otherwise("0")
    stored = F.array(
        cell(0, "s", F.col("idx")),
        cell(0, "str", F.col("o_orderstatus")),
        cell(1, None, F.col("o_totalprice").cast("decimal(18,2)")),
        cell(2, None, date_serial(F.col("o_orderdate"))),
        cell(0, "b", large),
        cell(9, None, F.col("o_custkey")),
    )
    cells = coded.select(
        F.lit("orders.xlsx").alias("path"),
        F.lit("sheet1.xml").alias("entry"),
        F.col("o_orderkey").alias("row_seq"),
        (F.col("o_orderkey") + 1).alias("row"),
        F.posexplode(stored).alias("pos", "c"),
    ).select("path", "entry", "row_seq", "row", "pos", cell_ref(F.col("pos"), F.col("row")).alias("ref"), "c.*")
    sheets = spark.createDataFrame([("orders.xlsx", "sheet1.xml", "Orders", 0)], "path string, entry string, sheet string, ordinal int")
    formats = spark.createDataFrame(
        [("orders.xlsx", 0, 0, None), ("orders.xlsx", 1, 4, None), ("orders.xlsx", 2, 14, None)],
        "path string, s int, format_id int, format_code string",
    )
    # One workbook with one sheet, three formats and five strings: broadcast is safe.
    styled = cells.join(F.broadcast(sheet_styles(sheets, formats)), ["path", "entry"])
    resolved = resolve_cells(styled, F.broadcast(strings))
    return resolved.select("sheet", "row", "ref", "col", "kind", "text")


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers printed as text, one source per nation, as rows of typed cells."""
    customer = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
    lines = table_lines(customer, path, F.col("c_custkey"), customer.columns, ";")
    settings = lines.withColumn("separator", F.lit(";")).withColumn("overrides", F.lit(None).cast("array<string>"))
    return with_typed_fields(settings).select("path", F.col("line_no").alias("row"), "cells")


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the stored rows of a workbook of two sheets, the second one chosen by its position: rows without cells
    leave nothing, cells without a value are empty."""
    orders = table(spark, sf_dir, "orders")
    key, row = F.col("o_orderkey"), (F.col("o_orderkey") + 1).cast("string")
    kind = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("<v>"), F.col("o_orderstatus"), F.lit("</v>")))
    cells = F.concat(F.lit('<c r="A'), row, F.lit('"><v>'), F.col("o_custkey").cast("string"), F.lit('</v></c><c r="B'), row,
                     F.lit('" t="str">'), kind, F.lit("</c>"))
    xml = F.concat(F.lit('<row r="'), row, F.lit('">'), F.when(key % 5 == 0, "").otherwise(cells), F.lit("</row>"))
    entry = F.concat(F.lit("xl/worksheets/sheet"), (key % 2).cast("string"), F.lit(".xml"))
    names = [("sheet", 0, '<sheet name="Even" r:id="r0"/>'), ("sheet", 1, '<sheet name="Odd" r:id="r1"/>'),
             *(("rel", i, f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>') for i in (0, 1))]
    fixed = spark.createDataFrame([("orders.xlsx", part, "xl/workbook.xml", seq, xml) for part, seq, xml in names], PART_SCHEMA)
    parts = fixed.unionByName(orders.select(
        F.lit("orders.xlsx").alias("path"), F.lit("row").alias("part"), entry.alias("entry"), key.alias("seq"), xml.alias("xml")))
    found = workbook_cells(fixed.select("path").distinct(), 1, parts=materialize(parts))
    return found.select("sheet", "row", "ref", "kind", "text")


def workbook_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed into one workbook per nation, unpacked, and resolved again."""
    # The parts of a workbook are read one kind at a time, so the workbooks are written first.
    books = materialize(export_workbooks(customer_rows(spark, sf_dir)).select("path", "content"))
    cells = workbook_cells(books)
    return cells.select("path", "sheet", "row", "col", "ref", "kind", "text", "style")


def workbook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same workbooks rendered as delimited text, small sheets forcing further workbooks."""
    books = export_workbooks(customer_rows(spark, sf_dir), rows_per_workbook=40)
    named = materialize(books.select(F.concat_ws("#", "path", "chunk").alias("path"), "content"))
    rows = densify(workbook_cells(named), ("path", "sheet", "row"))
    return render_lines(rows, ";", 1).select("path", "row", "line")


def sheet_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as sheet names and output paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"\?.*", "").alias("url"), F.col("url").alias("full"))
    book = F.concat("url", F.lit(".xlsx"))
    return pages.select(
        "page_id",
        safe_sheet_name(F.col("full")).alias("sheet"),
        path_base(book).alias("base"),
        path_extension(book).alias("extension"),
        output_path(book).alias("next_to_source"),
        output_path(F.concat("url", F.lit(".CSV")), F.lit("/out/")).alias("in_folder"),
        sheet_path(output_path(book), F.col("full")).alias("per_sheet"),
    )


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook names for parts that share a name, beside names that are taken already."""
    part = table(spark, sf_dir, "part")
    requests = part.select("p_partkey", F.col("p_name").alias("base"), F.lit(".xlsx").alias("extension"))
    taken = part.groupBy("p_name").agg(F.max("p_size").alias("size"), F.min("p_size").alias("least"))
    existing = taken.select(
        F.explode(
            F.array(
                F.concat("p_name", F.lit(".xlsx")),
                F.concat("p_name", F.lit("_2.xlsx")),
                F.concat_ws("_", "p_name", F.concat(F.col("size").cast("string"), F.lit(".xlsx"))),
            )
        ).alias("name")
    )
    return free_names(requests, existing, "p_partkey").select("p_partkey", "name")


QUERIES = {
    f.__name__: f
    for f in (
        typed_columns,
        separator_profile,
        document_line_profile,
        header_detect,
        blank_lines,
        line_numbering,
        field_count_consistency,
        split_documents,
        split_roundtrip,
        cell_kinds,
        override_kinds,
        column_type_report,
        document_cells,
        typed_table,
        unlike_sources,
        name_rules,
        rule_join,
        file_rules,
        full_line_profile,
        sheet_rows,
        german_numbers,
        lenient_numbers,
        date_formats,
        serial_dates,
        quote_modes,
        cell_refs,
        densify_cells,
        shared_string_cells,
        workbook_roundtrip,
        workbook_lines,
        sheet_paths,
        output_names,
    )
}
