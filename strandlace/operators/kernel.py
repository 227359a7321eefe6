"""Windowed diagonal scores, in two physical plans with the same rows.

``relational``: query positions are exploded and meet the subject's letters beside them,
along the diagonal (the anti-diagonal for the reverse strand).
``block``: a pair is cut into bands of whole pixel rows, dealt out over tasks; each
task sums the windows of some pixel rows at a time with numpy and hands
their lit pixels on before the next, so memory is bounded.  No pixel belongs to two
bands, so nothing is merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import div, image_dimension, keep_dot, pixel_scale
from .karlin import auto_pixel_factor, letter_karlin


@dataclass(frozen=True)
class Scoring:
    """Scores of letter pairs: ``match`` and ``mismatch`` for known letters, or a ``table`` indexed subject, query."""

    alphabet: str = "ACGT"
    match: int = 5
    mismatch: int = -4
    table: tuple[tuple[int, ...], ...] | None = None

    def rows(self) -> list[list[int]]:
        n = len(self.alphabet)
        return [list(r) for r in self.table] if self.table else [[self.match if i == j else self.mismatch for j in range(n)] for i in range(n)]

    def column(self, q: Column, s: Column) -> Column:
        """Score of two codes; unknown letters (null codes) score 0."""
        if self.table is None:
            score = F.when(q == s, self.match).otherwise(self.mismatch)
        else:
            flat = F.array(*(F.lit(x) for r in self.rows() for x in r))
            score = F.get(flat, s * len(self.alphabet) + q)
        return F.when(q.isNull() | s.isNull(), 0).otherwise(score)

    def padded(self) -> np.ndarray:
        """The table with a zero row and column for unknown letters."""
        t = np.zeros((len(self.alphabet) + 1,) * 2, np.int32)
        t[:-1, :-1] = self.rows()
        return t

    def codes(self, s: str) -> np.ndarray:
        table = np.full(256, len(self.alphabet), np.int64)
        for i, c in enumerate(self.alphabet):
            table[ord(c)] = table[ord(c.lower())] = i
        return table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def _codes(seq: str, scoring: Scoring) -> Column:
    """Array of the letters' codes; null for unknown letters."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.nullif(F.instr(F.lit(scoring.alphabet), F.upper(c)) - 1, F.lit(-1)))


def relational_hits(pairs: DataFrame, key: list[str], query: str, subject: str, scoring: Scoring, window: int, reverse: bool = False, self_plot: bool = False) -> DataFrame:
    """``key, q, s, v, qlen, slen``: every full window but each diagonal's first, with its score.

    A query position is a row with its window's letters and the subject beside it; its
    cells are made there, so no cell is shuffled or sorted, and a row holds one line of the plot.
    """
    codes = spread(pairs.select(*key, query, subject), key).select(*key, _codes(query, scoring).alias("_a"), _codes(subject, scoring).alias("_b")).where("_a is not null and _b is not null")
    if reverse:
        codes = codes.withColumn("_a", F.transform("_a", lambda c: F.when(c < 4, 3 - c).otherwise(c)))
    sized = codes.select("*", F.size("_a").alias("qlen"), F.size("_b").alias("slen")).where((F.col("qlen") > window) & (F.col("slen") > window))
    ends = sized.select("*", F.explode(F.sequence(F.lit(window), F.col("qlen") - 1)).alias("q"))
    lines = ends.select(*key, "qlen", "slen", "q", "_b", *(F.get("_a", F.col("q") - i).alias(f"_q{i}") for i in range(window)))
    # The subject's place of the query's letter i before the window's end.
    beside = lambda s, i: s + i if reverse else s - i
    score = lambda s: sum((scoring.column(F.col(f"_q{i}"), F.get("_b", beside(s, i))) for i in range(1, window)), scoring.column(F.col("_q0"), F.get("_b", s)))
    low, high = (F.lit(0), F.col("slen") - 1 - window) if reverse else (F.lit(window), F.col("slen") - 1)
    low = F.greatest(low, F.col("q")) if self_plot else low
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    cells = F.transform(places, lambda s: F.struct(s.alias("s"), score(s).cast("long").alias("v")))
    return lines.select(*key, "qlen", "slen", "q", F.inline(cells)).select(*key, "q", "s", "v", "qlen", "slen")


def lit_pixels(hits: DataFrame, sizes: DataFrame | None, key: list[str], window: int, zoom: int, factor: int, reverse: bool = False) -> DataFrame:
    """``key, px, py, value``: the brightest hit of each pixel; at zoom 1 each pixel has one.  ``sizes`` (``key, qlen, slen``) stands for the sizes that the hits bring."""
    half = window // 2
    hits = hits if sizes is None else hits.drop("qlen", "slen").join(sizes, key)
    cq, cs = F.col("q") - half, (F.col("s") + half if reverse else F.col("s") - half)
    lit = hits.where("v > 0").withColumns({"px": div(cq, F.lit(zoom)), "py": div(cs, F.lit(zoom)), "value": pixel_scale(F.col("v"), factor, window)})
    lit = lit.where(keep_dot(zoom, cq, cs, reverse) & (F.col("px") < image_dimension(F.col("qlen"), zoom)) & (F.col("py") < image_dimension(F.col("slen"), zoom)))
    return lit.select(*key, "px", "py", "value") if zoom == 1 else lit.groupBy(*key, "px", "py").agg(F.max("value").alias("value"))


_BAND = 1 << 21


def window_sums(m: np.ndarray, window: int) -> np.ndarray:
    """Sums of ``window`` consecutive cells of every diagonal of ``m``, by doubling; entry (i, j) is the window that starts there."""
    rows, cols = m.shape[0] - window + 1, m.shape[1] - window + 1
    total, done, power, size = None, 0, m, 1
    while True:
        if window & size:
            part = power[done : done + rows, done : done + cols]
            total = part if total is None else total + part
            done += size
        if done == window:
            return total
        power = power[:-size, :-size] + power[size:, size:]
        size *= 2


#: Cells that one band of a pair has at least.
BAND_CELLS = 1 << 27


def resolve(q: np.ndarray, s: np.ndarray, scoring: Scoring, window: int | None, factor: int) -> tuple[int, int] | None:
    """Window and pixel factor; a window of None and a factor of 0 follow from the letters' statistics (None where those don't exist)."""
    if window is not None and factor:
        return window, factor
    n = len(scoring.alphabet)
    share = [np.bincount(x[x < n], minlength=n) for x in (q, s)]
    if not all(x.sum() for x in share):
        return None
    try:
        k = letter_karlin(share[0] / share[0].sum(), share[1] / share[1].sum(), np.array(scoring.rows()))
    except ValueError:
        return None
    return k.window if window is None else window, factor or auto_pixel_factor(k.expected_residue)


def block_pixels(q: np.ndarray, s: np.ndarray, scoring: Scoring, window: int, zoom: int, factor: int, reverse: bool = False, self_plot: bool = False, rows: tuple[int, int] | None = None):
    """(px, py, value) of the lit pixels of two coded sequences, some pixel rows at a time; ``rows`` bounds py.

    The reverse strand is the forward plot of the complemented query against
    the subject read backwards.  Self plots stop at the diagonal.  Two sequences of
    known letters under match and mismatch scores are compared letter by letter in bytes.
    """
    n, m = len(q), len(s)
    if n <= window or m <= window:
        return
    width, height, half, letters = -(-n // zoom), -(-m // zoom), window // 2, len(scoring.alphabet)
    plain = scoring.table is None and window < 256 and q.max() < letters and s.max() < letters
    known = np.minimum(q, letters)
    known = np.where(known < 4, 3 - known, known) if reverse else known
    if plain:
        query, subject = known.astype(np.uint8), (s[::-1] if reverse else s).astype(np.uint8)
        cells = np.stack([query == c for c in range(letters)]).view(np.uint8)
        # A window's score follows from its number of matches.
        score = (scoring.match - scoring.mismatch) * np.arange(window + 1) + scoring.mismatch * window
        bright = np.minimum(255, np.maximum(score, 0).astype(np.int64) * factor // window)
        falls = scoring.match <= scoring.mismatch
        least = 0 if falls else int(np.searchsorted(score, 0, side="right"))
    else:
        table = scoring.padded()
        kind = np.int16 if int(np.abs(table).max()) * window < 2**15 else np.int64
        subject = s[::-1] if reverse else s
        cells = np.ascontiguousarray(table[:, known], dtype=kind)
    low, high = rows or (0, height)
    if plain and zoom > 1 and least > 0:
        yield from _zoomed(cells, subject, window, zoom, bright, least, reverse, self_plot, low, min(high, height))
        return
    each = max(1, _BAND // n // zoom)
    for top in range(low, min(high, height), each):
        # Subject positions whose centres lie in these pixel rows.
        first, last = top * zoom, min(min(top + each, high, height) * zoom, m + window) - 1
        a, b = (m - 1 - (last - half), m - (first - half)) if reverse else (first + half, last + half + 1)
        a, b = max(a, window), min(b, m)
        cols = min(n, b) if self_plot and not reverse else n
        if a >= b or cols <= window:
            continue
        v = window_sums(cells[subject[a - window + 1 : b], 1:cols], window)
        at = np.flatnonzero(v >= least) if plain and not falls else np.flatnonzero(score[v] > 0) if plain else np.flatnonzero(v > 0)
        r, c = np.divmod(at, v.shape[1])
        found = v.ravel()[at]
        value = bright[found] if plain else np.minimum(255, found.astype(np.int64) * factor // window)
        at_q, at_s = c + window, m - 1 - (r + a) if reverse else r + a
        cq, cs = at_q - half, at_s + half if reverse else at_s - half
        ok = (zoom - 1 - cs % zoom >= cq % zoom) if reverse else (cs % zoom >= cq % zoom)
        if self_plot:
            ok &= at_q <= at_s
        px, py = cq[ok] // zoom, cs[ok] // zoom
        inside = (px < width) & (py < height)
        code, value = (py * width + px)[inside], value[ok][inside]
        if len(code):
            # The brightest hit of each pixel.
            order = np.argsort(code * 256 + value, kind="stable")
            code, value = code[order], value[order]
            end = np.append(code[1:] != code[:-1], True)
            yield code[end] % width, code[end] // width, value[end]


#: Cells of one tile of a zoomed plot.
_TILE = 1 << 20


def _zoomed(cells: np.ndarray, subject: np.ndarray, window: int, zoom: int, bright: np.ndarray, least: int, reverse: bool, self_plot: bool, low: int, high: int):
    """``block_pixels`` for bytes at a zoom: tiles of one pixel row by some pixel columns, whose brightest kept window is found without listing hits."""
    n, m, half = cells.shape[1], len(subject), window // 2
    width = max(1, _TILE // (zoom + window) // zoom) * zoom
    phase = np.arange(zoom)
    for left in range(0, n, width):
        first, last = max(left + half, window), min(left + width + half, n)  # window ends whose centres lie in these columns
        if first >= last:
            continue
        part = np.ascontiguousarray(cells[:, first - window + 1 : last])
        centre = np.arange(first, last) - half
        px = centre // zoom
        starts = np.flatnonzero(np.concatenate(([True], px[1:] != px[:-1])))
        # Kept places of a pixel: one triangle of its cells.
        keep = np.where((zoom - 1 - phase if reverse else phase)[:, None] >= (centre % zoom)[None], 255, 0).astype(np.uint8)
        out = []
        for py in range(low, high):
            if reverse:
                a, b = max(py * zoom - half, 0), min((py + 1) * zoom - half, m - window)
                lines, at_s = slice(m - b - window + 1, m - a), np.arange(b - 1, a - 1, -1)
                kept = keep[a + half - py * zoom : b + half - py * zoom][::-1]
            else:
                a, b = max(py * zoom + half, window), min((py + 1) * zoom + half, m)
                lines, at_s = slice(a - window + 1, b), np.arange(a, b)
                kept = keep[a - half - py * zoom : b - half - py * zoom]
            # A self plot has no cells beyond the diagonal.
            stop = min(last, b) if self_plot else last
            if a >= b or first >= stop:
                continue
            v = window_sums(part[:, : stop - first + window - 1][subject[lines]], window) & kept[:, : stop - first]
            if self_plot and stop > a + 1:
                near = max(first, a + 1)
                v[:, near - first :][np.arange(near, stop)[None] > at_s[:, None]] = 0
            most = np.maximum.reduceat(v.max(axis=0), starts[: np.searchsorted(starts, stop - first)])
            lit = np.flatnonzero(most >= least)
            if len(lit):
                out.append((px[starts[lit]], np.full(len(lit), py), bright[most[lit]]))
        if out:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt out by key over enough tasks for work that grows with the square of a row; sequences are small beside it."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *key)


#: Pixels that are gathered into one Arrow batch.
_BATCH = 1 << 16


def _strands(forward, reverse, width: int):
    """(px, py, forward, reverse) of the pixels that either strand lights; 0 where one doesn't."""
    parts = [[np.concatenate(x) for x in zip(*strand, strict=True)] if strand else [np.zeros(0, np.int64)] * 3 for strand in (list(forward), list(reverse))]
    code = [py.astype(np.int64) * width + px for px, py, _ in parts]
    at, where = np.unique(np.concatenate(code), return_inverse=True)
    out = [np.zeros(len(at), np.int64) for _ in parts]
    cut = len(code[0])
    out[0][where[:cut]], out[1][where[cut:]] = parts[0][2], parts[1][2]
    return at % width, at // width, *out


def block_strands(pairs: DataFrame, key: list[str], query: str, subject: str, scoring: Scoring, window: int | None, zoom: int, factor: int, self_plot: bool = False, band_cells: int = BAND_CELLS) -> DataFrame:
    """``key, px, py, forward, reverse``: both strands' values of the pixels that either lights, 0 where one doesn't.

    A task scores both strands of some pixel rows and merges them there, so no pixel is shuffled.
    """

    def pixels(q, s, sizes, rows):
        step = max(1, _BAND // len(q) // zoom)
        for low in range(*rows, step):
            part = (low, min(low + step, rows[1]))
            both = (block_pixels(q, s, scoring, sizes[0], zoom, sizes[1], reverse, self_plot, part) for reverse in (False, True))
            out = _strands(*both, -(-len(q) // zoom))
            if len(out[0]):
                yield out

    return _banded(pairs, key, query, subject, scoring, window, zoom, factor, pixels, ["forward", "reverse"], band_cells)


#: Columns that hold the records of a pair's axes, and their type: residues that a record starts and stops at, sampled cells before it; ascending, apart from each other.
AXES, AXIS = ("x_axis", "y_axis"), "array<struct<start:bigint,stop:bigint,offset:bigint>>"


def onto_cells(found: tuple[np.ndarray, np.ndarray, np.ndarray], axes: list[pa.StructArray], zoom: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(px, py, value) of pixels moved to the sampled cells of their records, the brightest of each cell; pixels beyond all records go."""
    value, ok, cells = found[2], np.ones(len(found[2]), bool), []
    for at, axis in zip(found, axes, strict=False):
        if len(axis) == 0:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        start, stop, offset = (axis.field(j).to_numpy(zero_copy_only=False) for j in range(3))
        r = np.maximum(np.searchsorted(start, at, side="right") - 1, 0)
        ok &= (at >= start[r]) & (at < stop[r])
        cells.append(offset[r] + (at - start[r]) // zoom)
    (px, py), value = (c[ok] for c in cells), value[ok]
    order = np.lexsort((value, px, py))
    px, py, value = px[order], py[order], value[order]
    end = np.append((px[1:] != px[:-1]) | (py[1:] != py[:-1]), True)[: len(px)]
    return px[end], py[end], value[end]


def block_dotplot(pairs: DataFrame, key: list[str], query: str, subject: str, scoring: Scoring, window: int | None, zoom: int, factor: int, reverse: bool = False, self_plot: bool = False, band_cells: int = BAND_CELLS, ordered: bool = False, onto: int | None = None) -> DataFrame:
    """``key, px, py, value`` by the block plan; ``ordered`` by key and band within a task.  ``key`` columns are whole numbers or strings.

    ``onto`` (a zoom) moves pixels to the sampled cells of the records in ``AXES``, where they are scored; a cell may come more than once.
    """

    def pixels(q, s, sizes, rows):
        return block_pixels(q, s, scoring, sizes[0], zoom, sizes[1], reverse, self_plot, rows)

    return _banded(pairs, key, query, subject, scoring, window, zoom, factor, pixels, ["value"], band_cells, ordered, onto)


def _banded(pairs: DataFrame, key: list[str], query: str, subject: str, scoring: Scoring, window: int | None, zoom: int, factor: int, pixels, values: list[str], band_cells: int, ordered: bool = False, onto: int | None = None) -> DataFrame:
    """``key, px, py`` and ``values``: what ``pixels`` yields for each band, small plots gathered into larger batches."""
    numbers = ["px", "py", *values]

    def run(batches):
        held, size = [], 0

        def told():
            keys = [pa.concat_arrays([pa.repeat(k[j], n) for k, n, _ in held]) for j in range(len(key))]
            cols = [pa.array(np.concatenate([x[j] for _, _, x in held]), pa.int64()) for j in range(len(numbers))]
            return pa.RecordBatch.from_arrays([*keys, *cols], names=[*key, *numbers])

        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                q, s = (scoring.codes(cols[c][i].as_py() or "") for c in ("_q", "_s"))
                if not len(q) or not len(s) or (sizes := resolve(q, s, scoring, window, factor)) is None:
                    continue
                height, part, parts = -(-len(s) // zoom), cols["_band"][i].as_py(), cols["_bands"][i].as_py()
                for found in pixels(q, s, sizes, (height * part // parts, height * (part + 1) // parts)):
                    if onto is not None:
                        found = onto_cells(found, [cols[c][i].values if cols[c][i].is_valid else [] for c in AXES], onto)
                    if len(found[0]) == 0:
                        continue
                    held.append(([cols[k][i] for k in key], len(found[0]), found))
                    size += len(found[0])
                    if size >= _BATCH:
                        yield told()
                        held, size = [], 0
        if held:
            yield told()

    dealt = _dealt(pairs, key, query, subject, zoom, band_cells, [] if onto is None else [F.col(c).cast(AXIS) for c in AXES])
    return (dealt.sortWithinPartitions(*key, "_band") if ordered else dealt).mapInArrow(run, _schema(pairs, key, dict.fromkeys(numbers, "long")))


def _schema(pairs: DataFrame, key: list[str], fields: dict[str, str]) -> str:
    types = dict(pairs.select(*key).dtypes)
    return ", ".join(f"`{c}` {kind}" for c, kind in ({k: types[k] for k in key} | fields).items())


def _dealt(pairs: DataFrame, key: list[str], query: str, subject: str, zoom: int, band_cells: int | None, more: list[Column] = ()) -> DataFrame:
    """``key, _q, _s, _bands, more, _band``: the pairs' bands (one each where ``band_cells`` is None), dealt out over tasks."""
    size = F.length(query).cast("double") * F.length(subject)
    bands = F.lit(1) if band_cells is None else F.greatest(F.lit(1), F.least(F.ceil(F.coalesce(size, F.lit(0.0)) / band_cells), F.ceil(F.length(subject) / zoom))).cast("int")
    rows = pairs.select(*key, F.col(query).alias("_q"), F.col(subject).alias("_s"), F.coalesce(bands, F.lit(1)).alias("_bands"), *more)
    rows = rows.withColumn("_band", F.explode(F.sequence(F.lit(0), F.col("_bands") - 1)))
    return spread(rows, [*key, "_band"])


#: Pixels whose drawings are gathered into one Arrow batch.
_DRAWN = 1 << 20


def block_images(pairs: DataFrame, key: list[str], query: str, subject: str, scoring: Scoring, window: int | None, zoom: int, factor: int, strands: tuple[bool, ...], draw, fields: dict[str, str], whole: bool = False, band_cells: int = BAND_CELLS) -> DataFrame:
    """``key`` and ``fields`` (names and types): what ``draw`` makes of the plots' images, dark pixels included.

    ``draw`` gets a strip of whole pixel rows (a byte for each pixel, the brighter of the
    ``strands``, True for reverse) and the first one's place; it gives the columns of
    ``fields``.  Strips are filled in where they are scored, so no pixel is shuffled, and
    each pixel row is in one.  ``whole``: each plot is one strip, one task's work and bounded by
    its size, and so are plots of empty sequences.  Null sequences have no image.
    """

    def run(batches):
        held, size = [], 0

        def told():
            keys = [pa.concat_arrays([pa.repeat(k[j], len(x[0])) for k, x in held]) for j in range(len(key))]
            return pa.RecordBatch.from_arrays([*keys, *(pa.concat_arrays([x[j] for _, x in held]) for j in range(len(fields)))], names=[*key, *fields])

        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                letters = [cols[c][i].as_py() for c in ("_q", "_s")]
                if any(x is None or not (x or whole) for x in letters):
                    continue
                q, s = (scoring.codes(x) for x in letters)
                sizes = resolve(q, s, scoring, window, factor) if len(q) and len(s) else None
                width, height, part, parts = -(-len(q) // zoom), -(-len(s) // zoom), cols["_band"][i].as_py(), cols["_bands"][i].as_py()
                low, high = height * part // parts, height * (part + 1) // parts
                step = max(1, height if whole else _BAND // len(q) // zoom)
                for top in [0] if whole else range(low, high, step):
                    rows = (top, min(top + step, high))
                    image = np.zeros((rows[1] - top, width), np.uint8)
                    for reverse in strands if sizes else ():
                        for px, py, value in block_pixels(q, s, scoring, sizes[0], zoom, sizes[1], reverse, False, rows):
                            image[py - top, px] = np.maximum(image[py - top, px], value)
                    held.append(([cols[k][i] for k in key], draw(image, top)))
                    size += image.size
                    if size >= _DRAWN:
                        yield told()
                        held, size = [], 0
        if held:
            yield told()

    return _dealt(pairs, key, query, subject, zoom, None if whole else band_cells).mapInArrow(run, _schema(pairs, key, fields))
