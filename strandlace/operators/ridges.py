"""Diagonal ridges and raster operations on sparse pixels (``key, px, py, value``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import div, greyramp


def ridges(pixels: DataFrame, key: list[str], threshold: int = 40, min_length: int = 8, max_gap: int = 2) -> DataFrame:
    """Runs of lit pixels along both diagonal directions: ``key, direction, q0, s0, q1, s1, length, strength``.

    Runs bridge up to ``max_gap`` dark pixels and need ``min_length`` lit ones.
    """
    lit = pixels.where(F.col("value") >= threshold)
    both = lit.withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    lane = F.when(F.col("direction") == "forward", F.col("py") - F.col("px")).otherwise(F.col("py") + F.col("px"))
    both = both.withColumn("_lane", lane)
    along = Window.partitionBy(*key, "direction", "_lane").orderBy("px")
    new = F.coalesce((F.col("px") - F.lag("px").over(along) - 1 > max_gap).cast("int"), F.lit(0))
    runs = both.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    found = runs.groupBy(*key, "direction", "_lane", "_run").agg(F.min("px").alias("q0"), F.max("px").alias("q1"), F.count("*").alias("length"), F.max("value").alias("strength"))
    at = lambda q: F.when(F.col("direction") == "forward", F.col("_lane") + F.col(q)).otherwise(F.col("_lane") - F.col(q))
    return found.where(F.col("length") >= min_length).select(*key, "direction", "q0", at("q0").alias("s0"), "q1", at("q1").alias("s1"), "length", "strength")


def mirror(pixels: DataFrame, key: list[str], triangle: str = "both") -> DataFrame:
    """Self plots hold the lower triangle (px <= py): copied up, moved up or left as it is.

    A copy is made beside its pixel, so the pixels are computed once.
    """
    swap = {"px": "py", "py": "px"}
    if triangle == "both":
        own, turned = F.struct("px", "py"), F.struct(F.col("py").alias("px"), F.col("px").alias("py"))
        places = F.when(F.col("px") != F.col("py"), F.array(own, turned)).otherwise(F.array(own))
        return pixels.select(*(c for c in pixels.columns if c not in swap), F.inline(places)).select(*pixels.columns)
    return pixels.select(*(F.col(swap.get(c, c)).alias(c) for c in pixels.columns)) if triangle == "upper" else pixels


def merge_channels(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*key, "px", "py").agg(F.max("value").alias("value"))


def dark_runs(pixels: DataFrame, key: list[str], limit: int, threshold: int = 1) -> DataFrame:
    """``key, py, runs``: per row, the runs of lit pixels longer than ``limit``."""
    along = Window.partitionBy(*key, "py").orderBy("px")
    lit = pixels.where(F.col("value") >= threshold)
    lit = lit.withColumn("_run", F.col("px") - F.row_number().over(along))
    long = lit.groupBy(*key, "py", "_run").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return long.groupBy(*key, "py").agg(F.count("*").alias("runs"))


def resize_nearest(pixels: DataFrame, sizes: DataFrame | None, key: list[str], width: int) -> DataFrame:
    """Sparse nearest resample to ``width`` columns; ``sizes`` has ``key, width, height``, or the pixels have them where it is None."""
    placed = pixels if sizes is None else pixels.join(sizes, key)
    # Target cells whose floor(target * source / size) is the pixel: a range on each axis, empty for most pixels of a larger plot.
    first = lambda p, src, dst: div(p * dst + src - 1, src)
    x, y, w, h = F.col("px"), F.col("py"), F.col("width"), F.col("height")
    sized = placed.withColumns({"_w": F.lit(width).cast("long"), "_h": F.greatest(F.lit(1).cast("long"), div(width * h, w))})
    ranged = sized.withColumns({"_x0": first(x, w, F.col("_w")), "_x1": F.least(first(x + 1, w, F.col("_w")), F.col("_w")), "_y0": first(y, h, F.col("_h")), "_y1": F.least(first(y + 1, h, F.col("_h")), F.col("_h"))})
    hit = ranged.where("_x0 < _x1 AND _y0 < _y1").withColumn("_x", F.explode(F.sequence("_x0", F.col("_x1") - 1)))
    return hit.withColumn("_y", F.explode(F.sequence("_y0", F.col("_y1") - 1))).select(*key, F.col("_x").alias("px"), F.col("_y").alias("py"), "value")


def snap(pixels: DataFrame, crosshairs: DataFrame, key: list[str], radius: int = 64) -> DataFrame:
    """``key, px, py, value``: the brightest lit pixel around each crosshair (``key, cx, cy``), the nearest of several, the first by row and column of those."""
    near = pixels.join(crosshairs, key).where((F.abs(F.col("px") - F.col("cx")) <= radius) & (F.abs(F.col("py") - F.col("cy")) <= radius))
    far = F.pow(F.col("px") - F.col("cx"), F.lit(2)) + F.pow(F.col("py") - F.col("cy"), F.lit(2))
    best = F.max(F.struct(F.col("value"), (-far).alias("d"), (-F.col("py")).alias("y"), (-F.col("px")).alias("x")))
    return near.groupBy(*key).agg(best.alias("b")).select(*key, (-F.col("b.x")).alias("px"), (-F.col("b.y")).alias("py"), "b.value")


def images_of(pixels: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """``key, _w, _h, px, py, value``: the rows of ``sizes`` (``key, width, height``) and of ``pixels``, those of a plot in one partition, its size first.

    No join: Spark can't foresee how many pixels a plot has, and would broadcast them all.
    """
    none = F.lit(None).cast("long")
    long = lambda *cs: [F.col(c).cast("long") for c in cs]
    first = sizes.select(*key, *(c.alias(n) for c, n in zip(long("width", "height"), ("_w", "_h"), strict=True)), *(none.alias(c) for c in ("px", "py", "value")))
    lit = pixels.select(*key, none.alias("_w"), none.alias("_h"), *(c.alias(n) for c, n in zip(long("px", "py", "value"), ("px", "py", "value"), strict=True)))
    return first.unionByName(lit).repartition(*key).sortWithinPartitions(*key, F.col("_w").isNull())


def each_image(batches, keys: int):
    """The rows of ``images_of`` as (key columns of one row, image), one plot at a time; pixels of plots without a size go."""
    own = image = None
    for b in batches:
        names = b.columns[:keys]
        px, py, value = (pc.fill_null(b.column(keys + j), 0).to_numpy(zero_copy_only=False) for j in range(2, 5))
        sized = np.flatnonzero(pc.is_valid(b.column(keys)).to_numpy(zero_copy_only=False)).tolist()
        for s, e in zip([0, *sized], [*sized, b.num_rows], strict=True):
            if s == e:
                continue
            if b.column(keys)[s].is_valid:
                if image is not None:
                    yield own, image
                own = [pa.array([c[s].as_py()], c.type) for c in names]
                image, s = np.zeros((b.column(keys + 1)[s].as_py(), b.column(keys)[s].as_py()), np.uint8), s + 1
            # Rows are sorted by key: if the last one belongs to this plot, all do.
            while e > s and (image is None or any(c[e - 1] != o[0] for c, o in zip(names, own, strict=True))):
                e -= 1
            if e > s:
                image[py[s:e], px[s:e]] = value[s:e]
    if image is not None:
        yield own, image


#: Pixels of one batch of a rendered image, at least a row.
_RENDERED = 1 << 16


def _ramp(white: int, black: int) -> np.ndarray:
    """The grey of each value."""
    level = np.arange(256)
    return np.where(level <= white, 255, np.where(level >= black, 0, np.floor(255.5 - (level - white) * 255.0 / max(black - white, 1)))).astype(np.uint8)


#: Columns of ``grey_rows``.
GREY_ROWS = {"py": "long", "n": "long", "grey": "long"}


def grey_rows(white: int, black: int):
    """A drawing of ``block_images``: ``py, n, grey``, the pixels of each image row and the sum of their greys on the ramp."""
    ramp = _ramp(white, black)

    def draw(image: np.ndarray, top: int) -> list[pa.Array]:
        height, width = image.shape
        return [pa.array(np.arange(top, top + height)), pa.array(np.full(height, width)), pa.array(ramp[image].sum(axis=1, dtype=np.int64))]

    return draw


def render(pixels: DataFrame, sizes: DataFrame, key: list[str], white: int, black: int) -> DataFrame:
    """``key, px, py, grey`` of every pixel of each image (``sizes`` has ``key, width, height``) through the grey ramp.

    Only lit pixels are shuffled; a task fills in one image at a time.  Plots that are yet to be scored are drawn without a shuffle by ``block_images``.
    """
    grey = _ramp(white, black).astype(np.int32)

    def run(batches):
        for own, image in each_image(batches, len(key)):
            height, width = image.shape
            each = max(1, _RENDERED // max(width, 1))
            for top in range(0, height if width else 0, each):
                part = image[top : top + each]
                y, x = np.divmod(np.arange(part.size), width)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(c[0], part.size) for c in own), pa.array(x), pa.array(y + top), pa.array(grey[part.ravel()])], names=[*key, "px", "py", "grey"])

    kinds = dict(sizes.dtypes)
    dense = images_of(pixels, sizes.where("width > 0 and height > 0"), key)
    return dense.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", px long, py long, grey int")


def render_sized(pixels: DataFrame, sizes: DataFrame, key: list[str], width: int, height: int, white: int, black: int) -> DataFrame:
    """``key, x, y, grey`` of the pixels of a ``width`` by ``height`` image that aren't background, by nearest resampling of each plot (``sizes`` has ``key, width, height``).

    A target pixel shows the plot's pixel at ``floor(target * source / size)``
    on each axis.  Each lit pixel goes to its range of targets, so the work
    follows the lit pixels and never the area; all other targets show the grey of value 0.
    """
    if width < 1 or height < 1:
        raise ValueError("an image has at least one pixel")

    def targets(p: str, source: str, size: int) -> Column:
        first = lambda at: div(at * size + F.col(source) - 1, F.col(source))
        low, high = first(F.col(p)), F.least(first(F.col(p) + 1), F.lit(size).cast("long"))
        return F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>")))

    placed = pixels.join(sizes.where("width > 0 and height > 0").withColumnsRenamed({"width": "_w", "height": "_h"}), key)
    spread_x = placed.select(*key, "py", "value", "_h", targets("px", "_w", width).alias("x"))
    return spread_x.select(*key, "x", targets("py", "_h", height).alias("y"), greyramp(F.col("value"), white, black).alias("grey"))
