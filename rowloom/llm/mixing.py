"""Sources mixed to target weights, with documents drawn by Efraimidis and Spirakis.

Sources share the words of the whole corpus by weight. No source may give more than ``limit`` times its own
words; what is above goes to the others by weight, until none is above (water filling: the sources with the
smallest ratio of limit to weight are full first, which a running sum over the sorted sources finds at once).

A source whose target is several times its size gives complete epochs first: every document that many times.
The rest of the target is a weighted sample without replacement: each document has the key -ln(u) / weight,
with u from a hash of its id and the seed; documents are taken by ascending key while the running sum of
their words stays within the budget. What a long document leaves open at the end is filled in the same way
with documents that fit, and at last by the one document that comes nearest to what is left, if it helps.

The running sum works on slots of the key range of bounded size (``numbering.running_total``), so that a source
with most of the corpus is spread over all tasks.

Defined results: null text has no words; null sources are a source of their own, last in order; a source
without words has target 0. Weights of documents that are null count as 1, those not above 0 as 1e-6.
Repeated rows of an id have the same key and are ordered by their words. An empty table gives an empty plan. Other
columns of the documents stay with ``mixed``; a plan has the columns named here alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.operators.numbering import running_total
from rowloom.session import checked_broadcast

LIMIT = 3
CYCLE = (1, 2, 3)
SLOT_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, limit: int = LIMIT) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    The windows run over one row per source, whatever the number of documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), F.pmod(F.row_number().over(names) - 1, F.lit(len(cycle))) + 1)
    weighed = sizes.withColumn("w", weight.cast("bigint"))
    full_first = Window.orderBy((F.lit(limit) * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, everything = full_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything)
    left = total - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # if this source and all after it shared what the full ones leave: the level per weight
    level = left.cast("double") / weights.cast("double")
    shared = weighed.select("*", level.alias("level"), F.row_number().over(full_first).alias("n"))
    open_ = shared.withColumn("open", (F.col("level") * F.col("w") <= limit * F.col("source_size")))
    first_open = F.min(F.when(F.col("open"), F.struct("n", "level"))).over(Window.partitionBy())
    target = F.when(
        F.coalesce(F.col("n") >= first_open["n"], F.lit(False)), first_open["level"] * F.col("w")
    ).otherwise((limit * F.col("source_size")).cast("double"))
    return open_.select("source", "source_size", target.alias("target"))


def draw_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash of the key and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None,
        cycle: tuple[int, ...] = CYCLE, limit: int = LIMIT, seed: int = 2) -> DataFrame:
    """``(key, source, size, source_size, target, times, taken)`` of every row: how often the mix takes it, and its words."""
    sized = docs.withColumn("_llm_size", word_count(F.col(text)))
    return mix_sizes(sized, key, "_llm_size", source, weight, cycle, limit, seed)


def mix_sizes(docs: DataFrame, key: str = "doc_id", size: str = "size", source: str = "source", weight: str | None = None,
              cycle: tuple[int, ...] = CYCLE, limit: int = LIMIT, seed: int = 2) -> DataFrame:
    """:func:`mix` of rows whose sizes are known."""
    chance = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-6)) if weight else F.lit(1.0)
    rows = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"), chance.alias("w"),
    )
    rows = written(rows.withColumn("draw", draw_key(F.col("id"), F.col("w"), seed)), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.min("w").alias("least"))
    targets = source_targets(sizes.select("source", "source_size"), cycle, limit)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("bigint")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    counts = sizes.select(F.col("source").alias("s2"), "n", "least")
    plan = written(plan.join(counts, F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "plan")
    named = checked_broadcast(plan.withColumnRenamed("source", "s2"))  # one small row per source, measured
    all_rows = rows.join(named, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # 1 - exp(-key * least weight) is spread over (0, 1) with a density bounded by the ratio of the weights
    slots = F.ceil(F.col("n") / F.lit(SLOT_ROWS))
    slot = F.floor((1 - F.exp(-F.col("draw") * F.col("least"))) * slots).cast("bigint")
    group = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    order = [F.col("draw"), F.col("id").asc_nulls_last(), F.col("size")]
    spread = all_rows.withColumns({"group": group, "slot": slot})
    drawn = running_total(spread, ["group"], F.col("slot"), order, F.col("size"), "sum")
    drawn = written(drawn.withColumn("whole", F.col("sum") <= F.col("budget")), "drawn")
    # What the document that would have gone over leaves open is filled with those that fit, in the same order.
    rest = _with_gap(drawn, "whole").filter(~F.col("whole") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    filled = running_total(rest, ["group"], F.col("slot"), order, F.col("size"), "sum2")
    filled = filled.filter(F.col("sum2") <= F.col("gap")).select("group", "id", "size", "sum", F.lit(True).alias("fits"))
    same = ["group", "id", "size", "sum"]  # the running sum tells repeated rows apart
    drawn = _join_rows(drawn, filled, same).withColumn("whole", F.col("whole") | F.coalesce("fits", F.lit(False))).drop("fits")
    drawn = written(drawn, "filled")
    off = F.abs(F.col("size") - F.col("gap"))
    last = (
        _with_gap(drawn, "whole").filter(~F.col("whole") & (F.col("size") > 0) & (off < F.col("gap")))
        .groupBy("group").agg(F.min(F.struct(off.alias("off"), "draw", "id", "size", "sum")).alias("last"))
        .select("group", "last.id", "last.size", "last.sum", F.lit(True).alias("is_last"))
    )
    joined = _join_rows(drawn, checked_broadcast(written(last, "last")), same)
    is_last = F.coalesce("is_last", F.lit(False))
    times = F.col("epochs") + (F.col("whole") | is_last).cast("bigint")
    return joined.select(
        F.col("id").alias(key), F.col("source").alias("source"), "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def _with_gap(rows: DataFrame, taken: str) -> DataFrame:
    """``rows`` with what is left of the budget of their group."""
    got = F.coalesce(F.sum(F.when(F.col(taken), F.col("size"))), F.lit(0))
    gaps = rows.groupBy("group").agg((F.first("budget") - got).alias("gap"))
    return rows.join(checked_broadcast(written(gaps, "gaps")), "group")


def _join_rows(left: DataFrame, right: DataFrame, same: list[str]) -> DataFrame:
    """Left join on columns that may be null."""
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in same], *[c for c in right.columns if c not in same])
    condition = F.lit(True)
    for c in same:
        condition = condition & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(named, condition, "left").drop(*[f"r_{c}" for c in same])


def mixed(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` (of :func:`mix`) takes them, with the columns of ``docs``.

    Rows that share an id and a source are told apart by their words; of those with the same words, the order of the
    hashes of their texts says which is taken more often.
    """
    plan = written(plan.select(F.col(key).alias("_llm_key"), F.col("source").alias("_llm_source"), "size", "times"), "taken")
    often = plan.groupBy("_llm_key", "_llm_source").agg(F.count(F.lit(1)).alias("_llm_rows"), F.max("times").cast("int").alias("_llm_times"))
    often = written(often.filter("_llm_times > 0"), "often")
    # The texts are dealt by id once, at any size; how often each is taken is as much as the documents are.
    joined = docs.join(often.hint("merge"), F.col(key).eqNullSafe(F.col("_llm_key")) & F.col(source).eqNullSafe(F.col("_llm_source")))
    again = F.explode(F.array_repeat(F.lit(0), F.col("_llm_times"))).alias("_llm_again")
    single = joined.filter("_llm_rows = 1").select(*[F.col(c) for c in docs.columns], again).drop("_llm_again")
    if often.filter("_llm_rows > 1").isEmpty():
        return single
    same = ["_llm_key", "_llm_source", "_llm_size"]
    rows = joined.filter("_llm_rows > 1").drop("_llm_times").withColumn("_llm_size", word_count(F.col(text)))
    rows = rows.withColumn("_llm_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(F.col(text)))))
    taken = plan.withColumn("_llm_size", F.col("size")).withColumn(
        "_llm_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("times").desc())))
    taken = taken.filter("times > 0").select(*[F.col(c).alias(f"r{c}") for c in (*same, "_llm_n")], F.col("times").cast("int").alias("_llm_times"))
    condition = F.lit(True)
    for c in (*same, "_llm_n"):
        condition = condition & F.col(c).eqNullSafe(F.col(f"r{c}"))
    repeated = rows.join(taken, condition).select(*[F.col(c) for c in docs.columns], again).drop("_llm_again")
    return single.unionByName(repeated)
