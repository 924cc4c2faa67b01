"""Output names: next free name where a file must not be overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.numbering import SLOT, number_rows, running_total

# Slots that requests without a whole number to go by are spread over.
HASH_SLOTS = 4096


def free_names(requests: DataFrame, existing: DataFrame, order: str = "path") -> DataFrame:
    """``name`` for each row of ``requests(base, extension, ...)``, free in ``existing(name)``.

    The plain name first, then ``base_1``, ``base_2`` ... as the first numbers not taken. Requests
    for the same base take turns by ``order``, a unique column: by its value if it is a whole
    number, else by slots of its hash, so that any number of requests may share a base.
    """
    names = existing.select(F.col("name").alias("_name")).distinct()
    wanted = requests.select(F.concat("base", "extension").alias("_name")).distinct()
    # An existing name is taken as itself and as a numbered form of a shorter base; a requested
    # one as a numbered form only, so that no other request is given it.
    taken = _as_number(names).unionByName(_as_number(wanted)).unionByName(
        names.select(_stem().alias("base"), _extension().alias("extension"), F.lit(0).alias("number"))
    )
    base = ["base", "extension"]
    number = F.col("number").cast("bigint")
    ranked = number_rows(taken.distinct(), base, number, "_rank")
    # With r smaller numbers taken, number t stands after t - r free ones. The place of a request is
    # its turn plus the taken numbers that stand at or before it.
    at = (number - F.col("_rank") + 1).alias("_at")
    steps = ranked.groupBy(*base, at).agg(F.count(F.lit(1)).alias("_step"))
    turns = _turns(requests, base, order)
    asked = turns.select(*base, F.col("_turn").alias("_at"), F.lit(0).cast("bigint").alias("_step"))
    needed = steps.join(asked.select(*base).distinct(), base, "left_semi")
    both = asked.unionByName(needed)
    slot = F.floor(F.col("_at") / F.lit(SLOT))
    shifted = running_total(both, base, slot, [F.col("_at"), F.col("_step").desc()], F.col("_step"), "_shift")
    places = shifted.filter(F.col("_step") == 0).select(*base, F.col("_at").alias("_turn"), "_shift")
    place = F.col("_turn") + F.col("_shift")
    suffix = F.when(place == 0, "").otherwise(F.concat(F.lit("_"), place.cast("string")))
    return turns.join(places, [*base, "_turn"]).withColumn("name", F.concat("base", suffix, "extension")).drop(
        "_turn", "_shift"
    )


def _extension() -> Column:
    return F.regexp_extract("_name", r"(\.[^./\\]*)\z", 1)


def _stem() -> Column:
    return F.regexp_replace("_name", r"\.[^./\\]*\z", "")


def _as_number(names: DataFrame) -> DataFrame:
    """Names that end in a number as ``(base, extension, number)``."""
    ending = r"_([1-9][0-9]{0,8})\z"
    numbered = names.select(
        F.regexp_replace(_stem(), ending, "").alias("base"),
        _extension().alias("extension"),
        F.regexp_extract(_stem(), ending, 1).try_cast("int").alias("number"),
    )
    return numbered.filter(F.col("number").isNotNull())


def _turns(requests: DataFrame, base: list[str], order: str) -> DataFrame:
    """Requests with ``_turn``, their 0-based place among those for the same base."""
    if dict(requests.dtypes)[order] in ("tinyint", "smallint", "int", "bigint"):
        numbered = number_rows(requests, base, F.col(order), "_turn")
    else:
        slot = F.pmod(F.xxhash64(order), F.lit(HASH_SLOTS))
        numbered = running_total(requests, base, slot, [F.col(order)], F.lit(1), "_turn")
    return numbered.withColumn("_turn", F.col("_turn") - 1)
