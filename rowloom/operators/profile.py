"""What kind of text a source holds: separator, start line, header, field counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.numbers import parse_lenient_number
from rowloom.functions.split import (
    AUTO_SEPARATORS,
    NO_SEPARATOR,
    is_blank,
    plain_names,
    raw_fields,
    separator_count,
)
from rowloom.rules import DEFAULT_RULES, Rules, is_header_name, override_of
from rowloom.session import checked_broadcast, materialize

# Fixed value: lines looked at per source.
ANALYZE_LINES = 100

PROFILE_COLUMNS = (
    "separator",
    "separator_probability",
    "start_line",
    "end_line",
    "analyzed_lines",
    "total_lines",
    "field_count",
    "is_field_count_equal",
    "has_header",
    "header_names",
    "overrides",
)


def profile_heads(
    df: DataFrame,
    head: str = "head",
    total: str | None = None,
    separator: str | None = None,
    header: bool | None = None,
    rules: Rules = DEFAULT_RULES,
    candidates: tuple[str, ...] = AUTO_SEPARATORS,
) -> DataFrame:
    """Profile each row by its ``head``, the array of its first lines. No shuffle.

    ``separator`` and ``header`` override what would be found among the ``candidates``. ``total`` names the column with
    the number of lines of the whole source. ``overrides`` holds the type asked for by each
    header name.
    """
    lines = F.col(head)
    start = F.coalesce(F.array_position(F.transform(lines, lambda x: ~is_blank(x)), True), F.lit(0))
    out = df.withColumn("start_line", start.cast("bigint"))

    first_at = F.col("start_line").cast("int")
    content = F.when(first_at == 0, lines).otherwise(F.slice(lines, F.greatest(first_at, F.lit(1)), F.size(lines)))
    out = out.withColumn("_content", content).withColumn(
        "_first", F.when(first_at > 0, F.get(lines, first_at - 1)).otherwise("")
    )
    later = F.filter(F.slice(F.col("_content"), 2, F.greatest(F.size("_content"), F.lit(1))), lambda x: ~is_blank(x))
    out = out.withColumn("_second", F.when(first_at > 0, F.coalesce(F.get(later, 0), F.lit(""))).otherwise(""))

    if separator is None:
        out = _found_separator(out, candidates)
    else:
        out = out.withColumn("separator", F.lit(separator)).withColumn("separator_probability", F.lit(100.0))

    sep = F.col("separator")
    out = out.withColumn("_counts", F.transform("_content", lambda x: F.size(raw_fields(x, separator or sep))))
    names = plain_names(F.col("_first"), separator or sep)
    out = out.withColumn("_names", names)
    if header is None:
        out = out.withColumn("has_header", _found_header(separator or sep, rules))
    else:
        out = out.withColumn("has_header", F.lit(header))
    named = F.col("has_header") & (F.col("start_line") > 0)
    out = out.withColumn("header_names", F.when(named, F.col("_names")))

    counts = F.col("_counts")
    return (
        out.withColumn("end_line", F.size(lines).cast("bigint"))
        .withColumn("analyzed_lines", F.size(lines).cast("bigint"))
        .withColumn("total_lines", (F.col(total) if total else F.size(lines)).cast("bigint"))
        .withColumn("field_count", F.coalesce(F.get(counts, 0), F.lit(0)))
        .withColumn("is_field_count_equal", F.size(F.array_distinct(counts)) <= 1)
        .withColumn("overrides", F.transform("header_names", lambda x: override_of(x, rules)))
        .drop("_content", "_first", "_second", "_counts", "_names")
    )


def _found_separator(df: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """Most frequent candidate, the earlier one on a tie, and its share in percent."""
    counted = F.when(F.col("start_line") > 0, F.array_join("_content", "\n")).otherwise("")
    df = df.withColumn("_text", counted)
    # One struct, so that the counts are worked out once per source.
    df = df.withColumn(
        "_n", F.struct(*[separator_count(F.col("_text"), s).alias(f"c{i}") for i, s in enumerate(candidates)])
    )
    return _best_separator(df, candidates).drop("_text")


def _best_separator(df: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """The separator of rows with the struct ``_n``, the count of each candidate."""
    counts = [F.col(f"_n.c{i}") for i in range(len(candidates))]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    df = df.withColumn("_best", best).withColumn("_sum", sum(counts[1:], counts[0]))
    chain = F.when(F.col("_best") == 0, NO_SEPARATOR)
    for count, s in zip(counts, candidates):
        chain = chain.when(count == F.col("_best"), s)
    share = F.when(F.col("_sum") > 0, F.col("_best") / F.col("_sum") * 100).otherwise(F.lit(0.0))
    return (
        df.withColumn("separator", chain)
        .withColumn("separator_probability", share)
        .drop("_n", "_best", "_sum")
    )


def _found_header(sep: Column | str, rules: Rules) -> Column:
    """Is the first content line a header, judged by it and the next one?

    Not with fewer than two content lines, nor if the second has fewer fields than the first.
    A known name in the first line says yes; else numbers at the same place in both say no.
    """
    names = F.col("_names")
    values = plain_names(F.col("_second"), sep)
    known = F.exists(names, lambda x: is_header_name(x, rules))
    numeric = F.exists(
        F.zip_with(
            names,
            values,
            lambda a, b: parse_lenient_number(a).isNotNull() & parse_lenient_number(b).isNotNull(),
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    two_lines = (F.col("start_line") > 0) & (F.col("_second") != "")
    return (
        F.when(~two_lines, False)
        .when(F.size(values) < F.size(names), False)
        .when(known, True)
        .otherwise(~numeric)
    )


def profile_files(
    lines: DataFrame,
    separator: str | None = None,
    header: bool | None = None,
    analyze_lines: int | None = ANALYZE_LINES,
    rules: Rules = DEFAULT_RULES,
    totals: DataFrame | None = None,
    candidates: tuple[str, ...] = AUTO_SEPARATORS,
) -> DataFrame:
    """One profile per ``path`` of ``lines(path, line_no, line)``.

    One shuffle: the lines of the head of each source, at most ``analyze_lines``, and a count.
    ``totals(path, total_lines)`` saves the count when it is known, and only the head is read on. With None all lines
    are analyzed, see :func:`profile_lines`.
    """
    if analyze_lines is None:
        return profile_lines(lines, separator, header, rules, candidates)
    in_head = F.col("line_no") <= analyze_lines
    numbered = F.struct("line_no", "line")
    if totals is None:
        heads = lines.groupBy("path").agg(
            F.collect_list(F.when(in_head, numbered)).alias("_lines"), F.count(F.lit(1)).alias("_total")
        )
    else:
        heads = (
            lines.filter(in_head).groupBy("path").agg(F.collect_list(numbered).alias("_lines"))
            .join(totals.withColumnRenamed("total_lines", "_total"), "path", "right")
        )
    ordered = F.transform(F.array_sort(F.coalesce("_lines", F.array())), lambda x: x["line"])
    heads = heads.select("path", ordered.alias("_head"), "_total")
    profiled = profile_heads(heads, "_head", "_total", separator, header, rules, candidates)
    return profiled.select("path", *PROFILE_COLUMNS)


def profile_lines(
    lines: DataFrame,
    separator: str | None = None,
    header: bool | None = None,
    rules: Rules = DEFAULT_RULES,
    candidates: tuple[str, ...] = AUTO_SEPARATORS,
) -> DataFrame:
    """One profile per ``path`` over all lines of sources of any size, the same as of a head that holds them all.

    No lines are gathered: what a profile needs is a state of fixed size that merges (counts, least and most fields, the
    first two content lines), summed up in each task before it is shuffled. Three passes over ``lines``, which should be
    a stored table: where the content starts, the separators in it, and the fields that the chosen one gives.
    """
    solid = ~is_blank(F.col("line"))
    starts = materialize(lines.groupBy("path").agg(
        F.coalesce(F.min(F.when(solid, F.col("line_no"))), F.lit(0)).cast("bigint").alias("start_line"),
        F.count(F.lit(1)).alias("total_lines"),
    ))
    content = lines.join(checked_broadcast(starts), "path").filter(F.col("line_no") >= F.col("start_line"))
    in_text = F.col("start_line") > 0
    counts = [F.sum(F.when(in_text, separator_count(F.col("line"), s)).otherwise(0)).alias(f"c{i}") for i, s in enumerate(candidates)]
    later = solid & in_text & (F.col("line_no") > F.col("start_line"))
    merged = content.groupBy("path").agg(
        F.struct(*counts).alias("_n"),
        F.coalesce(F.min_by("line", F.when(solid & in_text, F.col("line_no"))), F.lit("")).alias("_first"),
        F.coalesce(F.min_by("line", F.when(later, F.col("line_no"))), F.lit("")).alias("_second"),
    )
    if separator is None:
        merged = _best_separator(merged, candidates)
    else:
        merged = merged.drop("_n").withColumn("separator", F.lit(separator)).withColumn("separator_probability", F.lit(100.0))
    chosen = materialize(merged)
    sep = separator or F.col("separator")
    split = content.join(checked_broadcast(chosen.select("path", "separator")), "path").withColumn(
        "_fields", F.size(raw_fields(F.col("line"), sep)))
    fields = split.groupBy("path").agg(
        F.min_by("_fields", "line_no").alias("field_count"), (F.min("_fields") == F.max("_fields")).alias("is_field_count_equal"))
    out = starts.join(chosen, "path").join(fields, "path").withColumn("_names", plain_names(F.col("_first"), sep))
    found = _found_header(sep, rules) if header is None else F.lit(header)
    named = F.col("has_header") & in_text
    return (
        out.withColumn("has_header", found)
        .withColumn("header_names", F.when(named, F.col("_names")))
        .withColumn("end_line", F.col("total_lines"))
        .withColumn("analyzed_lines", F.col("total_lines"))
        .withColumn("overrides", F.transform("header_names", lambda x: override_of(x, rules)))
        .select("path", *PROFILE_COLUMNS)
    )
