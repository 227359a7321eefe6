"""Column functions over scores, pixels and zoom levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b) -> Column:
    """Integer division of non-negative whole numbers."""
    return F.floor(a / b).cast("long")


def pixel_scale(v: Column, factor: int, window: int) -> Column:
    """``min(255, v * factor div window)`` of a positive window score, 0 of any other."""
    return F.when(v > 0, F.least(F.lit(255).cast("long"), div(v * factor, F.lit(window)))).otherwise(F.lit(0).cast("long"))


def ramp(p: Column, white: int = 40, black: int = 100) -> Column:
    """Sensitivity ramp: 0 up to ``white``, 255 from ``black``, truncated linear between."""
    if black <= white:
        return F.when(p <= white, 0).otherwise(255).cast("long")
    return F.when(p <= white, F.lit(0)).when(p >= black, F.lit(255)).otherwise(div((p - white) * 255, F.lit(black - white))).cast("long")


def greyramp(value: Column, white: int, black: int, swap: bool = False) -> Column:
    """Display grey of a pixel value: white up to ``white``, black from ``black``, rounded half up between."""
    grey = F.when(value <= white, 255).when(value >= black, 0).otherwise(F.floor(F.lit(255.5) - (value - white) * 255.0 / max(black - white, 1))).cast("int")
    return F.lit(255) - grey if swap else grey


def keep_dot(zoom: int, q: Column, s: Column, reverse: bool = False) -> Column:
    """Whether a hit may light its zoomed pixel: one triangle of the pixel's cells."""
    a, b = F.pmod(q, F.lit(zoom)), F.pmod(s, F.lit(zoom))
    return (zoom - 1 - b >= a) if reverse else (b >= a)


def image_dimension(length: Column, zoom) -> Column:
    return F.ceil(length / F.greatest(F.lit(1), zoom if isinstance(zoom, Column) else F.lit(zoom))).cast("long")


def auto_zoom(q: Column, s: Column, target: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(q, s) / max(1, target)).cast("long"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid; 93 steps are enough for any two 64-bit numbers."""
    step = lambda t, _: F.when(t["b"] == 0, t).otherwise(F.struct(t["b"].alias("a"), F.try_mod(t["a"], t["b"]).alias("b")))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda t: t["a"])


def gcd_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda g, x: gcd(g, x))


def snap_zoom(base: Column, period: Column, tolerance: float) -> Column:
    """A divisor of ``period`` near ``base``: the smallest from base on, else the largest below, within the tolerance factor; else base."""
    base, period = base.cast("long"), period.cast("long")
    low = F.ceil(base / tolerance).cast("long")
    high = F.greatest(base, F.floor(base * tolerance).cast("long"))
    fits = F.filter(F.sequence(low, high), lambda d: F.try_mod(period, d) == 0)
    up, down = F.array_min(F.filter(fits, lambda d: d >= base)), F.array_max(F.filter(fits, lambda d: d < base))
    done = period.isNull() | (period <= 1) | (F.try_mod(period, base) == 0)
    return base if tolerance < 1 else F.when(done, base).otherwise(F.coalesce(up, down, base))


def two_channel(forward: Column, reverse: Column) -> Column:
    """struct (r, g, b) of two greys: the forward grey, or magenta of the reverse ink where that is more."""
    ink = F.lit(255) - reverse
    more = ink > F.lit(255) - forward
    side = (reverse + div(ink * 220, F.lit(255))).cast("int")
    return F.struct(F.when(more, side).otherwise(forward).alias("r"), F.when(more, reverse).otherwise(forward).alias("g"), F.when(more, side).otherwise(forward).alias("b"))
