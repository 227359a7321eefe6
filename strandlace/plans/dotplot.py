"""Dot-matrix plots of sequence pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, translate_frame
from ..operators.kernel import AXES, Scoring, block_dotplot, block_images, block_strands, lit_pixels, relational_hits
from ..operators.ridges import merge_channels, mirror
from ..operators.tiles import record_axis


class PlotError(ValueError):
    """A plot that can't be made as asked."""


@dataclass(frozen=True)
class PlotConfig:
    """``window=None`` and ``factor=0`` follow from each pair's letter statistics; pairs without statistics then have no pixels."""

    window: int | None = 8
    factor: int = 12
    zoom: int = 1
    strand: str = "forward"  # forward, reverse or both
    scoring: Scoring = Scoring()
    self_plot: bool = False
    triangle: str = "both"  # of self plots: both, upper, lower
    disable_mirror: bool = False  # self plots stay as computed
    reverse_query: bool = False
    reverse_subject: bool = False
    plan: str = "block"  # block or relational
    memory_limit: int | None = None
    refuse_empty: bool = False  # an empty sequence is an error; else it has no pixels

    def check(self) -> PlotConfig:
        if self.zoom < 1 or (self.window is not None and self.window < 1):
            raise PlotError("zoom and window must be 1 or more")
        if self.factor < 0 or (self.plan != "block" and (self.window is None or not self.factor)):
            raise PlotError("the relational plan needs a window and a pixel factor")
        if self.strand != "forward" and len(self.scoring.alphabet) != 4:
            raise PlotError("only DNA has a reverse strand")
        return self

    def check_size(self, qlen: int, slen: int, separate: bool = False) -> None:
        """Refuse images beyond ``memory_limit`` bytes; separate strands need two channels."""
        need = -(-qlen // self.zoom) * -(-slen // self.zoom) * (2 if separate and self.strand == "both" else 1)
        if self.memory_limit is not None and need > self.memory_limit:
            raise PlotError(f"the image needs {need} bytes, the limit is {self.memory_limit}")


def _refused(pairs: DataFrame, cfg: PlotConfig, separate: bool) -> DataFrame:
    """The pairs, with an error raised for one that can't be plotted as asked."""
    q, s = F.length("query"), F.length("subject")
    if cfg.refuse_empty:
        pairs = pairs.where(F.assert_true((F.coalesce(q, F.lit(0)) > 0) & (F.coalesce(s, F.lit(0)) > 0), "a plot needs letters on both axes").isNull())
    if cfg.self_plot:
        pairs = pairs.where(F.assert_true(q == s, "self plots need sequences of equal length").isNull())
    if cfg.memory_limit is not None:
        need = F.ceil(q / cfg.zoom) * F.ceil(s / cfg.zoom) * (2 if separate and cfg.strand == "both" else 1)
        pairs = pairs.where(F.assert_true(need <= cfg.memory_limit, F.concat(F.lit("an image needs bytes beyond the limit: "), need.cast("string"))).isNull())
    return pairs


def _channel(pairs: DataFrame, key: list[str], cfg: PlotConfig, reverse: bool, ordered: bool = False, onto: int | None = None) -> DataFrame:
    if cfg.plan == "block":
        return block_dotplot(pairs, key, "query", "subject", cfg.scoring, cfg.window, cfg.zoom, cfg.factor, reverse, cfg.self_plot, ordered=ordered, onto=onto)
    hits = relational_hits(pairs, key, "query", "subject", cfg.scoring, cfg.window, reverse, cfg.self_plot)
    return lit_pixels(hits, None, key, cfg.window, cfg.zoom, cfg.factor, reverse)


def dotplot(pairs: DataFrame, key: list[str], cfg: PlotConfig = PlotConfig(), separate: bool = False, ordered: bool = False) -> DataFrame:
    """Lit pixels of each pair (``key, query, subject``): ``key, px, py, value``, and ``channel`` with ``separate``.

    Pairs are independent; the block plan deals out bands of them, whose strands
    are merged where they are scored.  Empty sequences have no pixels; self plots of unequal
    lengths and images beyond the memory limit raise an error.  ``ordered``: a task of
    the block plan gives its pairs in the order of their keys.
    """
    cfg.check()
    pairs = _refused(pairs, cfg, separate)
    if len(cfg.scoring.alphabet) == 4:
        flip = {c: reverse_complement(F.col(c)) for c, on in (("query", cfg.reverse_query), ("subject", cfg.reverse_subject)) if on}
        pairs = pairs.withColumns(flip) if flip else pairs
    if cfg.strand == "both" and cfg.plan == "block" and not cfg.self_plot and not separate:
        both = block_strands(pairs, key, "query", "subject", cfg.scoring, cfg.window, cfg.zoom, cfg.factor)
        return both.select(*key, "px", "py", F.greatest("forward", "reverse").alias("value"))
    channels = {s: _channel(pairs, key, cfg, s == "reverse", ordered) for s in (("forward", "reverse") if cfg.strand == "both" else (cfg.strand,))}
    if cfg.self_plot and not cfg.disable_mirror:
        channels = {s: mirror(x, key, cfg.triangle) for s, x in channels.items()}
    if separate:
        out = None
        for s, x in channels.items():
            x = x.withColumn("channel", F.lit(s))
            out = x if out is None else out.unionByName(x)
        return out
    if len(channels) == 2:
        return merge_channels(*channels.values(), key)
    return next(iter(channels.values()))


def two_strands(pairs: DataFrame, key: list[str], cfg: PlotConfig) -> DataFrame:
    """``key, px, py, forward, reverse``: the pixels that either strand of a plot lights, 0 where one doesn't."""
    cfg.check()
    if cfg.strand != "both" or cfg.plan != "block" or cfg.self_plot or cfg.reverse_query or cfg.reverse_subject:
        raise PlotError("two strands are those of a plain block plot of both")
    return block_strands(_refused(pairs, cfg, True), key, "query", "subject", cfg.scoring, cfg.window, cfg.zoom, cfg.factor)


def drawn_dotplot(pairs: DataFrame, key: list[str], draw, fields: dict[str, str], cfg: PlotConfig = PlotConfig(), whole: bool = False) -> DataFrame:
    """``key`` and ``fields``: what ``draw`` makes of every pixel of the plots, where they are scored (see ``block_images``); no pixel is shuffled.

    ``ridges.grey_rows`` and ``images.image_file`` are such drawings; the second needs ``whole`` plots.
    """
    cfg.check()
    if cfg.plan != "block" or cfg.self_plot or cfg.reverse_query or cfg.reverse_subject:
        raise PlotError("images are drawn of plain block plots")
    strands = {"forward": (False,), "reverse": (True,), "both": (False, True)}[cfg.strand]
    return block_images(_refused(pairs, cfg, False), key, "query", "subject", cfg.scoring, cfg.window, cfg.zoom, cfg.factor, strands, draw, fields, whole)


def tiled_dotplot(pairs: DataFrame, x_spans: DataFrame, y_spans: DataFrame, key: list[str], zoom: int, cfg: PlotConfig = PlotConfig()) -> DataFrame:
    """``record_tiles`` of the forward or reverse plots of the pairs, one a key, of records that don't overlap: ``key, px, py, value``.

    Pixels are moved to their cells where they are scored, beside the records of
    their axes, so only the brightest of each task's cells are shuffled and no pixel is.
    """
    cfg.check()
    if zoom < 1:
        raise ValueError("zoom must be 1 or more")
    if cfg.plan != "block" or cfg.self_plot or cfg.zoom != 1 or cfg.strand == "both" or cfg.reverse_query or cfg.reverse_subject:
        raise PlotError("record tiles are those of one strand of a plain block plot of single residues")
    for name, spans in zip(AXES, (x_spans, y_spans), strict=True):
        laid = record_axis(spans, key, zoom).where("stop > start")
        pairs = pairs.join(laid.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "offset"))).alias(name)), key)
    return _channel(_refused(pairs, cfg, False), key, cfg, cfg.strand == "reverse", onto=zoom).groupBy(*key, "px", "py").agg(F.max("value").alias("value"))


def translated_dotplot(pairs: DataFrame, key: list[str], cfg: PlotConfig) -> DataFrame:
    """A DNA query in its three forward frames against a protein subject; the image is as wide as ``qlen div 3``.

    A query without a codon raises an error, as does a matrix of DNA letters.
    """
    if len(cfg.scoring.alphabet) == 4:
        raise PlotError("a translated plot needs a protein matrix")
    pairs = pairs.where(F.assert_true(F.length("query") >= 3, "a translated query needs three letters").isNull())
    width = F.floor(F.length("query") / 3).cast("long")
    framed = None
    for f in range(3):
        protein = translate_frame(F.col("query"), f)
        x = pairs.select(*key, F.lit(f).alias("_f"), F.rpad(protein, width.cast("int"), ".").alias("query"), "subject")
        framed = x if framed is None else framed.unionByName(x)
    lit = _channel(framed.where("length(query) > 0"), [*key, "_f"], cfg.check(), False)
    return lit.groupBy(*key, "px", "py").agg(F.max("value").alias("value"))
