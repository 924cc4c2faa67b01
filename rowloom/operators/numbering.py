"""Exact row numbers without a global sort and without one task per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Key values per slot: bounds the rows of one window, and keeps the table of slots small.
SLOT = 1 << 15


def running_total(
    df: DataFrame, group: list[str], slot: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of ``group`` up to and including each row.

    ``slot`` cuts a group into pieces of bounded size and must not fall along ``order``. Rows are
    summed inside their slot, and a running total over the sums per slot (one small row per
    slot) gives the start of each, so one group may hold most of the table.
    """
    slotted = df.withColumns({"_slot": slot, "_value": value.cast("bigint")})
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slotted.groupBy(*group, "_slot").agg(F.sum("_value").alias("_sum"))
        .select(*group, "_slot", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy(*group, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slotted.join(starts, [*group, "_slot"])
        .withColumn(name, F.col("_start") + F.sum("_value").over(inside))
        .drop("_slot", "_value", "_start")
    )


def number_rows(df: DataFrame, group: str | list[str], key: Column, name: str = "line_no", span: int = SLOT) -> DataFrame:
    """1-based number of each row inside ``group`` by ascending ``key`` (unique whole numbers)."""
    keyed = df.withColumn("_key", key)
    groups = [group] if isinstance(group, str) else group
    slot = F.floor(F.col("_key") / F.lit(span))
    return running_total(keyed, groups, slot, [F.col("_key")], F.lit(1), name).drop("_key")


def head_rows(df: DataFrame, group: str, order: list[Column], n: int, name: str = "line_no") -> DataFrame:
    """The first ``n`` rows of each group, numbered.

    Spark keeps at most ``n`` rows per group in each task before it shuffles, so a hot group
    costs no more than a cold one.
    """
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).filter(F.col(name) <= n)
