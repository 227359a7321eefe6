"""Amplitude spectra of signals: mean removed, Hann window, padded to a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .periodogram import next_power_of_two


def amplitudes(signal: np.ndarray) -> tuple[np.ndarray, int]:
    """(amplitude of each bin, padded length)."""
    n = len(signal)
    padded = max(2, next_power_of_two(n))
    if n == 0:
        return np.zeros(padded // 2 + 1), padded
    x = np.asarray(signal, float) - np.mean(signal)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1))) if n > 1 else np.ones(1)
    return np.abs(np.fft.rfft(x * hann, padded)), padded


def spectrum(signals: DataFrame, key: str, values: str) -> DataFrame:
    """``key, bin, frequency, period, amplitude`` of each row's array ``values``; bin 0 has an infinite period."""

    def run(batches):
        for b in batches:
            ids, arrays = b.column(0), b.column(1)
            for i in range(b.num_rows):
                amp, padded = amplitudes(np.array(arrays[i].as_py() or [], float))
                bins = np.arange(len(amp))
                with np.errstate(divide="ignore"):
                    period = padded / bins
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(bins), ids.type), pa.array(bins, pa.int64()), pa.array(bins / padded), pa.array(period), pa.array(amp)], names=[key, "bin", "frequency", "period", "amplitude"])

    kind = dict(signals.dtypes)[key]
    return signals.select(key, F.col(values).cast("array<double>").alias("_v")).mapInArrow(run, f"`{key}` {kind}, bin long, frequency double, period double, amplitude double")


def rank_peaks(spectra: DataFrame, key: str, top: int) -> DataFrame:
    """Strict local maxima (neither end) by amplitude, ties to the lower bin, the first ``top`` with their ``peak_rank``."""
    along = Window.partitionBy(key).orderBy("bin")
    a = F.col("amplitude")
    maxima = spectra.withColumn("_up", a > F.lag(a).over(along)).withColumn("_down", a > F.lead(a).over(along)).where("_up and _down").drop("_up", "_down")
    return maxima.withColumn("peak_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("amplitude"), "bin"))).where(F.col("peak_rank") <= top)
