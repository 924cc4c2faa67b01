"""Rows in global order, each task with a slice of it and the first row of the slice that follows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def descending_slices(df: DataFrame, key: str, ties: str) -> DataFrame:
    """``df`` dealt into slices of descending ``key`` (a whole number; null last, ties by ``ties``), one per task.

    Adds ``_slice`` and ``_ahead``. Rows with ``_ahead`` come last in a slice: they are copies of the rows
    with the largest key of the next slice (of the first one, for the last slice), so that every row can see
    its successor without a second shuffle. A slice starts at a key that occurs, so the copies are the rows of
    one key per slice. The keys that start slices are as many as tasks; only they reach the driver.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)] + [1.0]
    found = df.select(F.col(key).cast("double").alias("k")).dropna().approxQuantile("k", shares, 0.1 / parts)
    starts = sorted({int(x) for x in found})
    count = max(1, len(starts))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        import numpy as np

        # number of starts at or above the key, less the largest key itself; twice that, plus one for a start
        values = keys.to_numpy(dtype="float64", na_value=-np.inf)
        edges = np.array(starts, "float64")
        slices = np.maximum(len(edges) - np.searchsorted(edges, values, side="left") - 1, 0)
        return pd.Series((slices * 2 + np.isin(values, edges)).astype("int32"))

    coded = df.withColumn("_code", place(F.col(key).cast("double")))
    own = F.struct(F.floor(F.col("_code") / 2).cast("int").alias("slice"), F.lit(False).alias("ahead"))
    before = F.pmod(F.floor(F.col("_code") / 2).cast("int") - 1, F.lit(count))
    copy = F.struct(before.alias("slice"), F.lit(True).alias("ahead"))
    at = F.explode(F.when(F.col("_code") % 2 == 1, F.array(own, copy)).otherwise(F.array(own)))
    dealt = coded.withColumn("_at", at).select(*df.columns, F.col("_at.slice").alias("_slice"), F.col("_at.ahead").alias("_ahead"))
    return dealt.repartitionById(count, F.col("_slice")).sortWithinPartitions(
        "_slice", "_ahead", F.col(key).desc_nulls_last(), ties
    )
