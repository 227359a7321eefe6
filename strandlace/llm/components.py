"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours link to the smallest of its neighbourhood (itself included)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.where("v > u"), low, "u", F.xxhash64("v"), 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours link to the smallest of them.  Edges have u > v, ``total`` at most."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(edges, low, "u", F.xxhash64("v"), total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: every node of an edge with the smallest node that it reaches.

    Rounds go on until the edge table repeats; each round's table is written to
    the shared folder, and its predecessor's goes.  Hubs need no gathering: minima are aggregated map-side, and
    the edges of a hub are dealt out where they join its minimum.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now, old = materialize(_small_star(_large_star(now, state[0]), state[0]), "edges"), now
        discard(old)
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
