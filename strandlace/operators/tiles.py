"""Layouts of plots over concatenated records: each pair of records is a tile that is sampled in its own coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import div

#: Residues of one block of the join of positions with records.
BLOCK = 1024


def record_axis(spans: DataFrame, key: list[str], zoom: int) -> DataFrame:
    """``spans`` (``key, start, stop``) with the place of each record on the sampled axis: ``offset`` and ``cells``, one at least."""
    cells = F.greatest(F.lit(1), F.ceil((F.col("stop") - F.col("start")) / zoom)).cast("long")
    before = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("cells", cells).withColumn("offset", F.coalesce(F.sum("cells").over(before), F.lit(0)).cast("long"))


def onto_axis(pixels: DataFrame, spans: DataFrame, key: list[str], column: str, zoom: int) -> DataFrame:
    """``pixels`` with ``column`` moved from residues to sampled cells; pixels beyond all records go.

    Positions meet records by an equi-join on blocks of residues, so neither a
    long axis nor its records are gathered in one task.
    """
    laid = record_axis(spans, key, zoom).where("stop > start")
    laid = laid.select(*key, F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("offset").alias("_offset"), F.explode(F.sequence(div(F.col("start"), F.lit(BLOCK)), div(F.col("stop") - 1, F.lit(BLOCK)))).alias("_block"))
    at = F.col(column)
    met = pixels.withColumn("_block", div(at, F.lit(BLOCK))).join(laid, [*key, "_block"]).where((at >= F.col("_start")) & (at < F.col("_stop")))
    return met.withColumn(column, F.col("_offset") + div(at - F.col("_start"), F.lit(zoom))).drop("_block", "_start", "_stop", "_offset")


def record_tiles(pixels: DataFrame, x_spans: DataFrame, y_spans: DataFrame, key: list[str], zoom: int) -> DataFrame:
    """Residue-resolution pixels sampled by maxima, tile by tile: ``key, px, py, value``.

    Equal records get equal tiles even where ``zoom`` does not divide their length.
    """
    if zoom < 1:
        raise ValueError("zoom must be 1 or more")
    moved = onto_axis(onto_axis(pixels, x_spans, key, "px", zoom), y_spans, key, "py", zoom)
    return moved.groupBy(*key, "px", "py").agg(F.max("value").alias("value"))
