"""Incremental periodograms over arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.periodogram import PeriodogramConfig, periodogram


def incremental_periodogram(records: DataFrame, key: str, seq: str, out: str, checkpoint: str, cfg: PeriodogramConfig = PeriodogramConfig(), arrived: str | None = None, delay: str = "1 hour") -> DataStreamWriter:
    """A stream writer that appends the periodogram of each new record to ``out``.

    Records that come again are dropped: by key, and with the column ``arrived``
    only as long as the watermark of ``delay`` lets them, which bounds the state.
    """
    new = records.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key]) if arrived else records.dropDuplicates([key])
    return periodogram(new, key, seq, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
