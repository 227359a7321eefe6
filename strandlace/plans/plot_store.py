"""A store of plots that views are cut from: nothing is scored twice, and a view reads only the tiles it meets.

A plot is named by the SHA-256 of its sequences and of what its scores depend on.
Its lit cells at full resolution lie in Parquet, each file's by plot and tile, so that
row groups outside a view are skipped by their statistics.  Any zoom of any
slice follows from them exactly: which cell may light a zoomed pixel depends on
where the slice begins, so coarser levels are taken from the cells, not from
each other.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import div
from .dotplot import PlotConfig, PlotError, dotplot

#: Cells of a tile's side; a packed cell has ten bits for its place on each axis and eight for its value.
TILE = 1 << 10
PLOTS = "plot string, run string, qlen long, slen long"
CELLS = "plot string, tx long, ty long, px long, py long, value long, run string"
VIEW = "plot string, q_start long, q_stop long, s_start long, s_stop long, zoom long"
HISTORY = f"session string, at long, {VIEW}"
#: Views whose bounds are written into the scan; beyond that the join alone selects.
FEW = 32
#: Share of a selection that is added on each side, so that a view can be moved a little.
MARGIN = 0.5


def rect_zoom(x0: Column, x1: Column, y0: Column, y1: Column, view: Column, qlen: Column, slen: Column, width: int, height: int, margin: float = MARGIN) -> Column:
    """The view of a rectangle drawn on another: struct (q_start, q_stop, s_start, s_stop, zoom, x, y).

    The corners are pixels of ``view`` (struct q_start, s_start, zoom) in any order.  The zoom is the
    smallest at which the selection fits a canvas of ``width`` by ``height``
    pixels; the slice is the selection and ``margin`` of it to each side, as
    far as the sequences go; (x, y) is where the selection begins in it.  Under
    three pixels either way it is null.
    """

    def axis(a: Column, b: Column, start: Column, size: Column) -> tuple[Column, ...]:
        low, high = F.least(a, b).cast("double"), F.greatest(a, b).cast("double")
        shown = F.ceil((size - start) / view["zoom"])
        clip = lambda p: F.least(F.greatest(p, F.lit(0.0)), shown.cast("double"))
        first = start + F.floor(clip(low) * view["zoom"])
        last = F.least(size, start + F.ceil(clip(high) * view["zoom"]))
        extent = F.greatest(F.lit(1).cast("long"), last - first)
        more = F.ceil(extent * margin)
        return high - low >= 3, first.cast("long"), extent, F.greatest(F.lit(0).cast("long"), first - more), F.least(size, last + more)

    q_ok, q_first, q_extent, q_start, q_stop = axis(x0, x1, view["q_start"], qlen)
    s_ok, s_first, s_extent, s_start, s_stop = axis(y0, y1, view["s_start"], slen)
    zoom = F.greatest(F.lit(1).cast("long"), F.ceil(q_extent / float(width)), F.ceil(s_extent / float(height))).cast("long")
    out = {"q_start": q_start, "q_stop": q_stop, "s_start": s_start, "s_stop": s_stop, "zoom": zoom, "x": (q_first - q_start) / zoom, "y": (s_first - s_start) / zoom}
    return F.when(q_ok & s_ok, F.struct(*(c.alias(k) for k, c in out.items())))


def _turns(columns: list[pa.Array]) -> np.ndarray:
    """For each row, whether one of the columns differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _tiled(batches):
    """Cells with their tiles, each batch's in the order of plots as they come and of their tiles."""
    for b in batches:
        if b.num_rows:
            px, py = (b.column(j).to_numpy() for j in (1, 2))
            tx, ty = px // TILE, py // TILE
            row = pa.array(np.lexsort((tx, ty, np.cumsum(_turns([b.column(0)])))))
            c = [b.column(0), pa.array(tx), pa.array(ty), *b.columns[1:]]
            yield pa.RecordBatch.from_arrays([x.take(row) for x in c], names=["plot", "tx", "ty", "px", "py", "value"])


def _packed(batches):
    """Cells of the same tile that follow each other as one row: ``plot, run, tx, ty, cells``, a number for each cell."""
    for b in batches:
        if b.num_rows:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            px, py, value = (c[n].to_numpy(zero_copy_only=False) for n in ("px", "py", "value"))
            first = np.flatnonzero(_turns([c[n] for n in ("plot", "run", "tx", "ty")]))
            cells = pa.ListArray.from_arrays(pa.array(np.append(first, b.num_rows).astype(np.int32)), pa.array(((px % TILE) << 18 | (py % TILE) << 8 | value).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c[n].take(pa.array(first)) for n in ("plot", "run", "tx", "ty")), cells], names=["plot", "run", "tx", "ty", "cells"])


class PlotStore:
    """Plots under one folder, made with one configuration; it may lie on any path that Spark writes to.

    ``plots`` lists what is there, ``cells`` holds the lit cells of each run of
    ``add``, ``history`` the views of each session.  A run's plots are listed after its
    cells are written; cells of a run that failed before that are never read.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: PlotConfig = PlotConfig()) -> None:
        if cfg.window is None or not cfg.factor or cfg.self_plot or cfg.strand == "both" or cfg.zoom != 1:
            raise PlotError("a store holds forward or reverse plots of pairs at full resolution, with a window and a pixel factor")
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg.check()
        self.about = hashlib.sha256(repr(sorted(asdict(replace(cfg, plan="block", memory_limit=None)).items())).encode()).hexdigest()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], schema)

    def named(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (``query, subject`` and others) with the name of their plot."""
        digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
        return pairs.withColumn("plot", F.sha2(F.concat_ws("/", F.lit(self.about), digest("query"), digest("subject")), 256))

    def plots(self) -> DataFrame:
        """``plot, run, qlen, slen``; of a plot that two runs made at once, one."""
        return self._read("plots", PLOTS).groupBy("plot").agg(F.min("run").alias("run"), F.max("qlen").alias("qlen"), F.max("slen").alias("slen"))

    def add(self, pairs: DataFrame) -> int:
        """Score the pairs that the store doesn't have, each different pair once; their number."""
        text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        fresh = self.named(pairs.select(text("query"), text("subject"))).dropDuplicates(["plot"]).join(self.plots().select("plot"), "plot", "left_anti")
        run = uuid.uuid4().hex
        # Cells stay where they are scored: a task takes its plots in order, and a large plot's bands are dealt out over files.
        cells = dotplot(fresh, ["plot"], self.cfg, ordered=True).mapInArrow(_tiled, "plot string, tx long, ty long, px long, py long, value long")
        cells.write.parquet(f"{self.path}/cells/run={run}")
        size = lambda c: F.length(c).cast("long")
        fresh.select("plot", F.lit(run).alias("run"), size("query").alias("qlen"), size("subject").alias("slen")).coalesce(8).write.mode("append").parquet(f"{self.path}/plots")
        return self._read("plots", PLOTS).where(F.col("run") == run).count()

    def views(self, views: DataFrame) -> DataFrame:
        """``plot, px, py, value`` of each view (the columns of ``VIEW``), with the view's other columns: the pixels of a fresh plot of the slice at the view's zoom."""
        extra = [c for c in views.columns if c != "plot"]
        half, w = self.cfg.window // 2, self.cfg.window
        known = views.join(self.plots().select("plot", "run"), "plot")
        met = known.withColumn("tx", F.explode(F.sequence(div(F.col("q_start"), F.lit(TILE)), div(F.greatest("q_start", F.col("q_stop") - 1), F.lit(TILE)))))
        met = met.withColumn("ty", F.explode(F.sequence(div(F.col("s_start"), F.lit(TILE)), div(F.greatest("s_start", F.col("s_stop") - 1), F.lit(TILE)))))
        # Whole tiles are shuffled; Spark can't foresee how many cells they hold, and must not broadcast them.
        tiles = self._met(views).mapInArrow(_packed, "plot string, run string, tx long, ty long, cells array<int>").hint("merge")
        hit = tiles.join(met, ["plot", "run", "tx", "ty"]).withColumn("_c", F.explode("cells"))
        place = lambda t, bits: F.col(t) * TILE + F.shiftright("_c", bits).bitwiseAND(F.lit(TILE - 1))
        hit = hit.select("plot", *extra, place("tx", 18).alias("px"), place("ty", 8).alias("py"), F.col("_c").bitwiseAND(F.lit(255)).cast("long").alias("value"))
        back = self.cfg.strand == "reverse"
        cq, cs, n, m = F.col("px") - F.col("q_start"), F.col("py") - F.col("s_start"), F.col("q_stop") - F.col("q_start"), F.col("s_stop") - F.col("s_start")
        # A window must lie inside the slice, as it must in a plot of its own; the first of each diagonal is left out.
        q_in = (cq + half >= w) & (cq + half < n)
        s_in = (cs - half >= 0) & (cs - half <= m - 1 - w) if back else (cs + half >= w) & (cs + half < m)
        zoom = F.col("zoom")
        lit = hit.where(q_in & s_in & self._kept(zoom, cq, cs, back)).withColumns({"_x": div(cq, zoom), "_y": div(cs, zoom)})
        lit = lit.where((F.col("_x") < F.ceil(n / zoom)) & (F.col("_y") < F.ceil(m / zoom)))
        return lit.groupBy("plot", *extra, "_x", "_y").agg(F.max("value").alias("value")).withColumnsRenamed({"_x": "px", "_y": "py"})

    def _met(self, views: DataFrame) -> DataFrame:
        """The stored cells; of a few views, with their tiles' bounds as a filter that the scan can use to skip row groups and files."""
        cells = self._read("cells", CELLS)
        few = views.select("plot", *(f.split()[0] for f in VIEW.split(", ")[1:5])).limit(FEW + 1).collect()
        if len(few) > FEW:
            return cells
        bounds = F.lit(False)
        for v in few:
            bounds |= (F.col("plot") == v["plot"]) & F.col("tx").between(v["q_start"] // TILE, v["q_stop"] // TILE) & F.col("ty").between(v["s_start"] // TILE, v["s_stop"] // TILE)
        return cells.where(bounds)

    @staticmethod
    def _kept(zoom: Column, q: Column, s: Column, reverse: bool) -> Column:
        a, b = F.pmod(q, zoom), F.pmod(s, zoom)
        return (zoom - 1 - b >= a) if reverse else (b >= a)

    def remember(self, views: DataFrame) -> None:
        """Append views (``session`` and the columns of ``VIEW``; one for each session) to the sessions' histories."""
        last = self._read("history", HISTORY).groupBy("session").agg(F.max("at").alias("_last"))
        rows = views.join(last, "session", "left").withColumn("at", F.coalesce(F.col("_last") + 1, F.lit(0)).cast("long"))
        rows.select(*(f.split()[0] for f in HISTORY.split(", "))).write.mode("append").parquet(f"{self.path}/history")

    def back(self, steps: int = 1) -> DataFrame:
        """Each session's view ``steps`` before its last; sessions with fewer have none."""
        order = Window.partitionBy("session").orderBy(F.desc("at"))
        return self._read("history", HISTORY).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == steps + 1).drop("_n")
