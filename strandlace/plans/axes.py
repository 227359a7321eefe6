"""Axes of exported plots: a table of marks, and their SVG elements.

Marks are rows, so the axes of all plots of a run are planned at once: minor and
labelled major ticks at round steps, and the names of records over their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import format_kb, nice_step, xml_escape

#: Pixels that a record must span for its name to be shown, on the horizontal and the vertical axis.
SHOWN = {"x": 18.0, "y": 12.0}
#: Minor ticks between two labelled ones.
MINOR = 5


def _ticks(axes: DataFrame, key: list[str], kind: str, step: Column, label: Column) -> DataFrame:
    at = F.explode(F.when(step >= 1, F.sequence(F.lit(0).cast("long"), F.col("size"), step)).otherwise(F.array().cast("array<long>")))
    return axes.select(*key, "axis", F.lit(kind).alias("kind"), at.alias("_t")).select(*key, "axis", "kind", F.col("_t").cast("double").alias("at"), label.alias("label"))


def axis_marks(sizes: DataFrame, key: list[str], spans: DataFrame | None = None) -> DataFrame:
    """``key, axis, kind, at, label`` of the plots in ``sizes`` (``key, width, height`` in pixels).

    Kind is major (labelled, at ``nice_step`` of the axis), minor (a fifth of
    that, where it is a whole pixel) or record.  ``spans`` has the records of
    each axis (``key, axis, name, start, stop`` in pixels): a name stands in the
    middle of what the axis shows of its record, if that is wide enough.
    Axes without pixels have no marks but those at 0.
    """
    side = lambda axis, c: sizes.select(*key, F.lit(axis).alias("axis"), F.greatest(F.lit(0), F.col(c)).cast("long").alias("size"))
    axes = side("x", "width").unionByName(side("y", "height"))
    step = nice_step(F.col("size"))
    minor = F.floor(step / MINOR).cast("long")
    marks = _ticks(axes, key, "minor", minor, F.lit(None).cast("string")).unionByName(_ticks(axes, key, "major", step, format_kb(F.col("_t"))))
    if spans is None:
        return marks
    shown = spans.join(axes, [*key, "axis"]).where("stop > start and start < size").withColumn("_stop", F.least("stop", "size"))
    least = F.when(F.col("axis") == "x", SHOWN["x"]).otherwise(SHOWN["y"])
    wide = shown.where(F.col("_stop") - F.col("start") >= least)
    names = wide.select(*key, "axis", F.lit("record").alias("kind"), ((F.col("start") + F.col("_stop")) / 2.0).alias("at"), F.col("name").cast("string").alias("label"))
    return marks.unionByName(names)


def mark_elements(marks: DataFrame, key: list[str], margin: int = 60) -> DataFrame:
    """``key, elements``: the SVG of each plot's marks around an image at (``margin``, ``margin``); minor ticks first, names last."""
    at = F.format_string("%.1f", F.col("at") + float(margin))
    text = xml_escape(F.coalesce("label", F.lit("")))

    def line(length: int) -> Column:
        across = F.concat(F.lit('<path d="M'), at, F.lit(f' {margin}v-{length}" stroke="#444"/>'))
        down = F.concat(F.lit(f'<path d="M{margin} '), at, F.lit(f'h-{length}" stroke="#444"/>'))
        return F.when(F.col("axis") == "x", across).otherwise(down)

    def words(x_place: str, y_place: str, size: int, more: str = "") -> Column:
        across = F.concat(F.lit('<text x="'), at, F.lit(f'" {x_place} text-anchor="middle" font-size="{size}"{more}>'), text, F.lit("</text>"))
        down = F.concat(F.lit(f'<text {y_place} y="'), at, F.lit(f'" dominant-baseline="middle" font-size="{size}"{more}>'), text, F.lit("</text>"))
        return F.when(F.col("axis") == "x", across).otherwise(down)

    major = F.concat(line(6), words(f'y="{margin - 10}"', f'text-anchor="end" x="{margin - 10}"', 11))
    record = words(f'y="{margin - 28}"', 'text-anchor="start" x="2"', 11, ' font-weight="bold"')
    drawn = F.when(F.col("kind") == "minor", line(3)).when(F.col("kind") == "major", major).otherwise(record)
    rank = F.when(F.col("kind") == "minor", 0).when(F.col("kind") == "major", 1).otherwise(2)
    rows = marks.select(*key, F.struct(rank.alias("rank"), F.col("axis"), F.col("at"), drawn.alias("svg")).alias("m"))
    # An axis has some fifty marks and the names that fit it.
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["svg"]), "\n").alias("elements"))
