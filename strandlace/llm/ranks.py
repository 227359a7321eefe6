"""Gapless ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group, without bringing a group to one task.

    Rows are ranked inside (group, bucket of ``spread``); the buckets' counts, a
    small table, are summed to offsets.  ``df`` should be cheap to scan twice.
    """
    b = "_sl_bucket"
    rows = df.withColumn(b, F.pmod(spread, F.lit(buckets)))
    counts = rows.groupBy(*group, b).agg(F.count("*").alias("_sl_n"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, b, F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).cast("long").alias("_sl_before"))
    inner = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order))
    ranked = rows.withColumn("_sl_rank", inner.cast("long") - 1)
    return ranked.join(offsets, [*group, b]).withColumn(name, F.col("_sl_before") + F.col("_sl_rank")).drop(b, "_sl_before", "_sl_rank")
