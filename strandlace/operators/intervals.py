"""Positions located in intervals: an equi-join on bins, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import div

#: Width of a bin where none is given.
BIN = 1 << 10


def locate(probes: DataFrame, spans: DataFrame, group: list[str], position: str, bin_width: int = BIN, how: str = "left") -> DataFrame:
    """``probes`` with the columns of the span (``group, start, stop`` and others; half-open) that holds their ``position``.

    With ``how`` left, probes outside all spans have nulls, with inner they go;
    null positions are outside; where spans overlap, a probe comes once for each.
    A span stands in every bin that it meets, so disjoint spans make as many rows
    as there are spans and bins; neither a group nor a bin is gathered, and a bin
    with many probes is a skewed join key that adaptive execution splits.
    """
    if bin_width < 1:
        raise ValueError("bin_width must be 1 or more")
    bins = F.sequence(div(F.col("start"), F.lit(bin_width)), div(F.col("stop") - 1, F.lit(bin_width)))
    laid = spans.where("stop > start").withColumn("_bin", F.explode(bins)).withColumnsRenamed({"start": "_start", "stop": "_stop"})
    asked = probes.withColumn("_bin", div(F.col(position), F.lit(bin_width)))
    p, s = asked.alias("p"), laid.alias("s")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in [*group, "_bin"]]
    inside = (F.col(f"p.{position}") >= F.col("s._start")) & (F.col(f"p.{position}") < F.col("s._stop"))
    met = p.join(s, [*same, inside], how)
    own = [F.col(f"p.{c}") for c in probes.columns]
    more = [F.col(f"s.{c}") for c in laid.columns if c not in (*group, "_bin", "_start", "_stop")]
    return met.select(*own, F.col("s._start").alias("start"), F.col("s._stop").alias("stop"), *more)
