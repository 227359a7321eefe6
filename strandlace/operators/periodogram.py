"""Self-periodograms: diagonal sums by offset, null models and z-scores."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import pixel_scale, ramp
from .kernel import Scoring, resolve, spread


@dataclass(frozen=True)
class PeriodogramConfig:
    """``window=None`` and ``factor=0`` follow from each record's letter statistics; records without statistics then have no rows."""

    window: int | None = 8
    factor: int = 12
    min_offset: int = 3
    max_offset: int | None = None  # half the length where None
    white: int = 40
    black: int = 100
    scoring: Scoring = Scoring()


def settled(codes: np.ndarray, cfg: PeriodogramConfig) -> PeriodogramConfig | None:
    """The configuration with the record's own window and factor; None where its letters have no statistics."""
    if cfg.window is not None and cfg.factor:
        return cfg
    found = resolve(codes, codes, cfg.scoring, cfg.window, cfg.factor)
    return found and replace(cfg, window=found[0], factor=found[1])


@lru_cache(maxsize=64)
def _levels(cfg: PeriodogramConfig) -> tuple[np.ndarray, np.ndarray]:
    """The pixel level of a window by its number of matches, and the signal by level."""
    w, levels = cfg.window, np.arange(256)
    lut = np.where(levels <= cfg.white, 0, np.where(levels >= cfg.black, 255, (levels - cfg.white) * 255 // max(1, cfg.black - cfg.white)))
    return np.clip(np.maximum(0, (cfg.scoring.match - cfg.scoring.mismatch) * np.arange(w + 1) + cfg.scoring.mismatch * w) * cfg.factor // w, 0, 255), lut


def scorer(cfg: PeriodogramConfig, plain: bool) -> Callable[[np.ndarray, np.ndarray], tuple[int, int]]:
    """(raw sum, signal sum) over all windows of two equally long stretches of codes; ``plain`` where no unknown letter is among them."""
    w = cfg.window
    level, lut = _levels(cfg)
    if plain and cfg.scoring.table is None and w < 256:
        # A window's score follows from its number of matches: windows are counted by matches, in bytes.
        lit = np.flatnonzero(level)
        seen, ramped, each = level[lit], lut[level[lit]], lit.tolist()

        def by_matches(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
            v = _sums((x == y).view(np.uint8), w)
            times = np.array([np.count_nonzero(v == m) for m in each]) if len(each) <= 32 else np.bincount(v, minlength=w + 1)[lit]
            return int(seen @ times), int(ramped @ times)

        return by_matches
    table = cfg.scoring.padded()

    def by_table(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        total = np.concatenate(([0], np.cumsum(table[x, y], dtype=np.int32)))
        p = np.minimum(255, np.maximum(total[w:] - total[:-w], 0).astype(np.int64) * cfg.factor // w)
        return int(p.sum()), int(lut[p].sum())

    return by_table


#: Widest window that ``_bit_sums`` reads from 16 letters, bytes of mismatches that it holds at a time, and letters up to which a sum fits half of its 64 bits.
_BIT_WINDOW, _BIT_BYTES, _BIT_LETTERS = 9, 1 << 16, 1 << 23


@lru_cache(maxsize=64)
def _bit_table(cfg: PeriodogramConfig) -> np.ndarray:
    """By the mismatches of 16 letters (the first one highest): the sums of the windows that start at the first 8, raw sums below bit 32 and signal sums above."""
    level, lut = _levels(cfg)
    both = level.astype(np.int64) + (lut[level].astype(np.int64) << 32)
    hit = 1 - np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16).astype(np.int64)
    total = np.concatenate((np.zeros((1 << 16, 1), np.int64), hit.cumsum(axis=1)), axis=1)
    return sum(both[total[:, i + cfg.window] - total[:, i]] for i in range(8))


def _bit_sums(x: np.ndarray, ks: np.ndarray, cfg: PeriodogramConfig) -> tuple[np.ndarray, np.ndarray]:
    """(raw sums, signal sums) of all windows of known letters against those ``ks`` (ascending, each leaving a window) places on.

    Letters are planes of bits, packed at each of the eight places in a byte, so that a
    diagonal is a run of bytes; many diagonals are compared at a time, and a table scores eight windows at once.
    """
    n, w, table = len(x), cfg.window, _bit_table(cfg)
    bits = max(1, (len(cfg.scoring.alphabet) - 1).bit_length())
    # Letters beyond the end match none.
    size = (n + int(ks[-1] - ks[0])) // 8 + 8
    planes = np.zeros((bits + 1, 8 * size + 8), np.uint8)
    planes[:bits, :n] = x >> np.arange(bits, dtype=np.uint8)[:, None] & 1
    planes[bits, n:] = 1
    packed = np.packbits(as_strided(planes, (bits + 1, 8, 8 * size), (planes.shape[1], 1, 1)), axis=2)
    sums = np.empty(len(ks), np.int64)
    at = 0
    while at < len(ks):
        wide = (n - int(ks[at]) + 7) // 8 + 1
        k = ks[at : at + max(1, _BIT_BYTES // wide)]
        beside = as_strided(packed, (bits + 1, 8, size - wide + 1, wide), (*packed.strides, 1))[:, k % 8, k // 8]
        miss = beside[bits]
        for b in range(bits):
            miss |= beside[b] ^ packed[b, 0, :wide]
        sums[at : at + len(k)] = table[miss[:, :-1].astype(np.uint16) << 8 | miss[:, 1:]].sum(axis=1)
        at += len(k)
    if w > 1:
        # Windows that hang over the end.
        last = np.arange(n - 1, n - w, -1)
        level, lut = _levels(cfg)
        over = level[np.cumsum(x[last - ks[:, None]] == x[last], axis=1)]
        return (sums & 0xFFFFFFFF) - over.sum(axis=1), (sums >> 32) - lut[over].sum(axis=1)
    return sums & 0xFFFFFFFF, sums >> 32


def known(codes: np.ndarray, cfg: PeriodogramConfig) -> bool:
    return len(codes) == 0 or codes.max() < len(cfg.scoring.alphabet)


def diagonal_sums(codes: np.ndarray, cfg: PeriodogramConfig, part: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, raw sum, signal sum, pairs) of one coded sequence, dense over the offsets; O(length) memory.  ``part`` (i, n) takes the i-th of n equal ranges of offsets."""
    n, w = len(codes), cfg.window
    top = n // 2 if cfg.max_offset is None else cfg.max_offset
    wide = max(0, top + 1 - cfg.min_offset)
    ks = np.arange(cfg.min_offset + wide * part[0] // part[1], cfg.min_offset + wide * (part[0] + 1) // part[1])
    raw, signal = np.zeros(len(ks), np.int64), np.zeros(len(ks), np.int64)
    plain = known(codes, cfg)
    if plain and cfg.scoring.table is None and w <= _BIT_WINDOW and n < _BIT_LETTERS and not _levels(cfg)[0][0]:
        fit = int(np.count_nonzero(ks < n - w))
        if fit:
            raw[:fit], signal[:fit] = _bit_sums(codes[1:].astype(np.uint8), ks[:fit], cfg)
        return ks, raw, signal, np.maximum(0, n - w - ks)
    score, codes = scorer(cfg, plain), codes.astype(np.uint8) if plain else codes
    for i, k in enumerate(ks):
        if n - w - k <= 0:
            break
        # A diagonal's first window is left out.
        raw[i], signal[i] = score(codes[k + 1 :], codes[1 : n - k])
    return ks, raw, signal, np.maximum(0, n - w - ks)


def _sums(x: np.ndarray, w: int) -> np.ndarray:
    """Sums of ``w`` (under 256) consecutive bits, by doubling."""
    n = len(x) - w + 1
    total, done, power, size = None, 0, x, 1
    while True:
        if w & size:
            part = power[done : done + n]
            total = part if total is None else total + part
            done += size
        if done == w:
            return total
        power = power[:-size] + power[size:]
        size *= 2


#: Cells of one range of offsets at least.
PART_CELLS = 1 << 28


#: Rows that are gathered into one Arrow batch.
_BATCH = 1 << 16


def periodogram(records: DataFrame, key: str, seq: str, cfg: PeriodogramConfig = PeriodogramConfig(), keep: list[str] | None = None, part_cells: int = PART_CELLS, told: bool = False) -> DataFrame:
    """``key, k, raw_sum, signal_sum, n_pairs``, and with ``told`` the ``window`` and ``factor`` used: dense over offsets; records without an offset in range give none.

    One row of input is a record; long ones are cut into ranges of offsets, dealt out over tasks.
    ``keep`` columns of the record are passed on to its rows.
    """
    keep, used = keep or [], told
    numbers = ["k", "raw_sum", "signal_sum", "n_pairs", *(["window", "factor"] if told else [])]

    def run(batches):
        for b in batches:
            seqs, held, size = b.column(1), [], 0

            def told():
                row = pa.array(np.repeat([i for i, _ in held], [len(x[0]) for _, x in held]))
                cols = [pa.array(np.concatenate([x[j] for _, x in held]), pa.int64()) for j in range(len(numbers))]
                return pa.RecordBatch.from_arrays([b.column(0).take(row), *cols, *(b.column(4 + j).take(row) for j in range(len(keep)))], names=[key, *numbers, *keep])

            for i in range(b.num_rows):
                codes = cfg.scoring.codes(seqs[i].as_py() or "")
                own = settled(codes, cfg)
                if own is None:
                    continue
                found = diagonal_sums(codes, own, (b.column(2)[i].as_py(), b.column(3)[i].as_py()))
                if len(found[0]):
                    held.append((i, (*found, *([np.full(len(found[0]), x) for x in (own.window, own.factor)] if used else []))))
                    size += len(found[0])
                if size >= _BATCH:
                    yield told()
                    held, size = [], 0
            if held:
                yield told()

    kinds = dict(records.dtypes)
    size = F.coalesce(F.length(seq), F.lit(0)).cast("double")
    offsets = F.floor(size / 2) if cfg.max_offset is None else F.lit(float(cfg.max_offset))
    parts = F.greatest(F.lit(1), F.least(F.ceil(size * offsets / part_cells), offsets)).cast("int")
    rows = records.select(key, F.col(seq).alias("_seq"), parts.alias("_parts"), *keep)
    if cfg.max_offset is None or cfg.max_offset > 100:
        rows = spread(rows.select(key, "_seq", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_parts", *keep), [key, "_part"])
    else:
        rows = rows.select(key, "_seq", F.lit(0).alias("_part"), F.lit(1).alias("_parts"), *keep)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}" + "".join(f", {c} long" for c in numbers) + "".join(f", `{c}` {kinds[c]}" for c in keep))


#: Type of the column that ``periodogram_profiles`` adds.
PROFILE = "array<struct<k:bigint,raw_sum:bigint,signal_sum:bigint,n_pairs:bigint>>"


def periodogram_profiles(records: DataFrame, seq: str, cfg: PeriodogramConfig, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each record with its periodogram as one array, ``profile``; null where the sequence is null.

    For bands of offsets: a record is one task's work, in the partition where it lies.
    """
    if cfg.max_offset is None:
        raise ValueError("a profile needs max_offset")
    kind = pa.struct([(c, pa.int64()) for c in ("k", "raw_sum", "signal_sum", "n_pairs")])

    def run(batches):
        for b in batches:
            parts = [None if s is None else diagonal_sums(cfg.scoring.codes(s), cfg) for s in b.column(0).to_pylist()]
            sizes = np.array([0 if p is None else len(p[0]) for p in parts], np.int64)
            fields = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts if p is not None)]) for i in range(4)]
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(kind))
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            offsets = pa.array(ends, mask=np.array([p is None for p in parts] + [False]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(offsets, values)], names=[*keep, "profile"])

    kinds = dict(records.dtypes)
    return records.select(F.col(seq).alias("_seq"), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"profile {PROFILE}"]))


def score_arrays(records: DataFrame, key: str, seq: str, cfg: PeriodogramConfig = PeriodogramConfig(), part_cells: int = PART_CELLS) -> DataFrame:
    """``key, base, v``: the mean signals of each record as one array from its first offset on; records without an offset in range give none.

    Ranges of offsets of long records are dealt out; a range comes as one array, so few rows are shuffled.
    """

    def run(batches):
        for b in batches:
            held, size = [], 0

            def told():
                ends = np.cumsum([0, *(len(v) for _, _, v in held)]).astype(np.int32)
                means = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v for _, _, v in held])))
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _, _ in held])), pa.array([k for _, k, _ in held], pa.int64()), means], names=[key, "base", "v"])

            for i in range(b.num_rows):
                codes = cfg.scoring.codes(b.column(1)[i].as_py())
                own = settled(codes, cfg)
                if own is None:
                    continue
                k, _, signal, n = diagonal_sums(codes, own, (b.column(2)[i].as_py(), b.column(3)[i].as_py()))
                if len(k):
                    held.append((i, int(k[0]), np.where(n > 0, signal / np.maximum(n, 1), 0.0)))
                    size += len(k)
                if size >= _BATCH:
                    yield told()
                    held, size = [], 0
            if held:
                yield told()

    kind = dict(records.dtypes)[key]
    text = F.coalesce(F.col(seq), F.lit(""))
    size = F.length(text).cast("double")
    offsets = F.floor(size / 2) if cfg.max_offset is None else F.lit(float(cfg.max_offset))
    parts = F.greatest(F.lit(1), F.least(F.ceil(size * offsets / part_cells), offsets)).cast("int")
    rows = records.select(key, text.alias("_seq"), parts.alias("_parts")).select(key, "_seq", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_parts")
    ranges = spread(rows, [key, "_part"]).mapInArrow(run, f"`{key}` {kind}, base long, v array<double>")
    joined = ranges.groupBy(key).agg(F.min("base").alias("base"), F.sort_array(F.collect_list(F.struct("base", "v"))).alias("_r"))
    return joined.select(key, "base", F.flatten(F.transform("_r", lambda r: r["v"])).alias("v"))


def periodogram_relational(records: DataFrame, key: str, seq: str, cfg: PeriodogramConfig) -> DataFrame:
    """The same rows by windows over positions; needs ``max_offset``.

    Records are dealt out whole, and their positions explode where they lie: the
    letter ``k`` places on is a lead, a diagonal's window a frame over its scores, and
    no shuffle or join ever sees a position.
    """
    if cfg.max_offset is None:
        raise ValueError("the relational plan needs max_offset")
    w, ks = cfg.window, range(cfg.min_offset, cfg.max_offset + 1)
    at = F.instr(F.lit(cfg.scoring.alphabet), F.upper(F.col("_c"))) - 1
    letters = F.filter(F.split(F.coalesce(F.col(seq), F.lit("")), ""), lambda c: c != "")
    # A row of input is a record of its own, whatever its key.
    dealt = spread(records.select(key, seq), [key]).select(key, letters.alias("_l"), F.monotonically_increasing_id().alias("_row"))
    pos = dealt.select(key, "_row", F.size("_l").alias("_n"), F.posexplode_outer("_l").alias("q", "_c")).select(key, "_row", "_n", "q", F.when((at >= 0) & (F.col("_c") != ""), at).alias("qc"))
    along = Window.partitionBy(key, "_row").orderBy("q")
    ahead = pos.select("*", *(F.lead("qc", k).over(along).alias(f"_c{k}") for k in ks))
    cells = ahead.select(key, "_row", "_n", "q", *(cfg.scoring.column(F.col("qc"), F.col(f"_c{k}")).alias(f"_m{k}") for k in ks))
    frame = along.rowsBetween(-(w - 1), 0)
    scored = cells.select(key, "_row", "_n", "q", *(F.sum(f"_m{k}").over(frame).alias(f"_v{k}") for k in ks))
    lit = scored.select(key, "_row", "_n", *(F.when((F.col("q") >= w) & (F.col("q") + k < F.col("_n")), pixel_scale(F.col(f"_v{k}"), cfg.factor, w)).otherwise(F.lit(0).cast("long")).alias(f"_p{k}") for k in ks))
    sums = lit.groupBy(key, "_row", "_n").agg(*(f for k in ks for f in (F.sum(f"_p{k}").alias(f"_r{k}"), F.sum(ramp(F.col(f"_p{k}"), cfg.white, cfg.black)).alias(f"_s{k}"))))
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_r{k}").alias("raw_sum"), F.col(f"_s{k}").alias("signal_sum"), F.greatest(F.lit(0), F.col("_n") - w - k).cast("long").alias("n_pairs")) for k in ks))
    return sums.select(key, F.inline(rows))


def signal_mean() -> Column:
    return F.when(F.col("n_pairs") > 0, F.col("signal_sum") / F.col("n_pairs")).otherwise(0.0)


def analytical_null(a: Column, c: Column, g: Column, t: Column, match: int = 5, mismatch: int = -4) -> Column:
    """struct (mean, variance) of one cell's score at the letter counts of a record."""
    n = a + c + g + t
    same = F.when(n > 0, (a * a + c * c + g * g + t * t) / (n * n).cast("double")).otherwise(0.0)
    known = F.when(n > 0, 1.0).otherwise(0.0)
    mean = same * match + (known - same) * mismatch
    return F.struct(mean.alias("mean"), F.greatest(F.lit(0.0), same * match**2 + (known - same) * mismatch**2 - mean * mean).alias("variance"))


def analytical_z(mean: Column, variance: Column, factor: int | Column) -> Column:
    squared = float(factor**2) if isinstance(factor, int) else (factor * factor).cast("double")
    sd = F.sqrt(F.col("n_pairs") * squared * variance)
    return F.when((F.col("n_pairs") == 0) | (sd <= 2.220446049250313e-16), 0.0).otherwise((F.col("raw_sum") - F.col("n_pairs") * factor * mean) / sd)


#: Fixed value: the state that a zero seed stands for.
ZERO_SEED = 0x9E3779B97F4A7C15


def z_mode(mode: str, white: int, black: int) -> str:
    """``auto`` is analytical for the identity ramp and empirical otherwise."""
    return mode if mode != "auto" else ("analytical" if (white, black) == (0, 255) else "empirical")


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << math.ceil(math.log2(n)) if n & (n - 1) else n
