"""Peaks of periodograms and spectra: maxima, harmonic ladders, sub-repeats, thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeaksConfig:
    min_score: float = 10.0
    harmonic_tolerance: float = 0.02
    max_harmonic_n: int = 30
    min_harmonics: int = 1
    boundary_fraction: float = 0.9
    subrepeat_min_score: float | None = None  # no sub-repeats where None
    max_divisor: int = 6
    period_tolerance: int = 2


@dataclass
class Peak:
    period: float
    score: float
    kind: str = "fundamental"
    parent: float | None = None
    n: int | None = None
    divisor: int | None = None
    ladder: set[int] = field(default_factory=set)


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def harmonic_number(longer: float, shorter: float, cfg: PeaksConfig) -> int | None:
    """n where ``longer`` is about n times ``shorter``, from 2 to the largest allowed."""
    ratio = longer / shorter if shorter else math.inf
    if not math.isfinite(ratio):
        return None
    n = _half_up(ratio)
    return n if 2 <= n <= cfg.max_harmonic_n and abs(ratio - n) / n <= cfg.harmonic_tolerance else None


class Ladders:
    """Classification of candidate peaks into fundamentals and their harmonics.

    ``falling`` says that harmonics have the smaller period (spectra).
    """

    def __init__(self, candidates: list[tuple[float, float]], cfg: PeaksConfig, falling: bool = False) -> None:
        self.cfg, self.falling = cfg, falling
        self.peaks = [Peak(p, s) for p, s in sorted(candidates, key=lambda x: (-x[1], x[0]))]
        self.claim()
        self.merge()
        self.settle()

    def fundamentals(self) -> list[Peak]:
        return [p for p in self.peaks if p.kind == "fundamental"]

    def number(self, peak: Peak, base: Peak) -> int | None:
        pair = (base.period, peak.period) if self.falling else (peak.period, base.period)
        return harmonic_number(*pair, self.cfg)

    def best(self, peak: Peak, bases: list[Peak]) -> tuple[Peak, int] | None:
        """The base that explains a peak best: relative error, then distance (1e-12 counts as equal), then n, then score."""
        found = None
        for base in bases:
            n = self.number(peak, base)
            if n is None:
                continue
            due = base.period / n if self.falling else base.period * n
            off = abs(peak.period - due)
            rank = (off / max(abs(due * self.cfg.harmonic_tolerance), 2.220446049250313e-16), off)
            if found is None or self.nearer(rank, n, base, found):
                found = rank, n, base
        return (found[2], found[1]) if found else None

    @staticmethod
    def nearer(rank, n, base, old) -> bool:
        for a, b in zip(rank, old[0], strict=True):
            if abs(a - b) > 1e-12:
                return a < b
        return (n, -base.score) < (old[1], -old[2].score)

    def claim(self) -> None:
        """Strongest first: a peak joins the ladder that explains it best, or founds one."""
        bases: list[Peak] = []
        for p in self.peaks:
            if hit := self.best(p, bases):
                p.kind, p.parent, p.n = "harmonic", hit[0].period, hit[1]
            else:
                bases.append(p)

    def merge(self) -> None:
        """A fundamental that is another's harmonic joins it with its own harmonics, until none is left."""
        while True:
            bases = self.fundamentals()
            pair = next(((f, g) for f in bases for g in bases if f is not g and self.number(f, g)), None)
            if pair is None:
                return
            f, g = pair
            n = self.number(f, g)
            for p in self.peaks:
                if p.kind == "harmonic" and p.parent == f.period:
                    p.parent, p.n = g.period, p.n * n
            f.kind, f.parent, f.n = "harmonic", g.period, n

    def settle(self) -> None:
        """Harmonics choose anew among the final fundamentals; ladders count those that match."""
        bases = self.fundamentals()
        for p in self.peaks:
            if p.kind == "harmonic" and (hit := self.best(p, bases)):
                p.parent, p.n = hit[0].period, hit[1]
                hit[0].ladder.add(hit[1])


def local_maxima(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1 if len(x) > 2 else np.zeros(0, int)


def subrepeats(peaks: list[Peak], x: np.ndarray, base: int, cfg: PeaksConfig) -> list[Peak]:
    """Peaks near a fundamental's period divided by 2, 3, ... that are no candidates themselves."""
    known = {int(p.period) for p in peaks}
    edged = np.concatenate(([-np.inf], x, [-np.inf]))
    out = []
    for p in peaks:
        if p.kind != "fundamental":
            continue
        for n in range(2, cfg.max_divisor + 1):
            target = _half_up(p.period / n)
            if target < 3:
                break
            near = np.arange(max(3, base, target - cfg.period_tolerance), min(target + cfg.period_tolerance, base + len(x) - 1) + 1)
            if not len(near):
                continue
            at = int(near[np.argmax(x[near - base])])
            s, i = x[at - base], at - base + 1
            if s >= cfg.subrepeat_min_score and s > edged[i - 1] and s > edged[i + 1] and at not in known:
                out.append(Peak(float(at), float(s), "subrepeat", p.period, divisor=n))
    return out


def peaks_of_scores(x: np.ndarray, base: int, cfg: PeaksConfig = PeaksConfig()) -> list[Peak]:
    """Classified peaks of a dense score vector whose first entry is offset ``base``."""
    x = np.asarray(x, float)
    if not len(x) or np.isnan(x).all():
        return []
    cap = math.inf if cfg.boundary_fraction >= 1 else int((base + len(x) - 1) * cfg.boundary_fraction)
    found = [(float(base + i), float(x[i])) for i in local_maxima(x).tolist() if x[i] >= cfg.min_score and base + i <= cap]
    ladders = Ladders(found, cfg)
    subs = subrepeats(ladders.peaks, x, base, cfg) if cfg.subrepeat_min_score is not None else []
    kept = [p for p in ladders.peaks if p.kind != "fundamental" or len(p.ladder) >= cfg.min_harmonics]
    return sorted(kept + subs, key=lambda p: -p.score)


def peaks_of_bins(candidates: list[tuple[float, float]], cfg: PeaksConfig = PeaksConfig()) -> list[Peak]:
    """Classified peaks of ranked spectrum bins (period, amplitude): harmonics have smaller periods, no sub-repeats."""
    ladders = Ladders([(p, s) for p, s in candidates if math.isfinite(p) and s >= cfg.min_score], cfg, falling=True)
    return sorted((p for p in ladders.peaks if p.kind != "fundamental" or len(p.ladder) >= cfg.min_harmonics), key=lambda p: -p.score)


PEAK_FIELDS = "period double, score double, kind string, parent double, harmonic_n int, divisor_n int, n_harmonics int, harmonics array<int>"


#: Peaks that are gathered into one Arrow batch.
_BATCH = 1 << 14


def _batches(key: str, kind: pa.DataType, found):
    """Arrow batches of (key, peaks) pairs; those of many keys share one."""
    types = (pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))

    def told():
        cols = zip(*((p.period, p.score, p.kind, p.parent, p.n, p.divisor, len(p.ladder) if p.kind == "fundamental" else None, sorted(p.ladder)) for _, p in held), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([owner for owner, _ in held], kind), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(f.split()[0] for f in PEAK_FIELDS.split(", "))])

    held: list = []
    for owner, peaks in found:
        held += ((owner, p) for p in peaks)
        if len(held) >= _BATCH:
            yield told()
            held = []
    if held:
        yield told()


def find_peaks(profiles: DataFrame, key: str, values: str, base: str, cfg: PeaksConfig = PeaksConfig(), floor: str | None = None) -> DataFrame:
    """Peaks of each row: ``values`` is the dense score array from offset ``base`` on; the column ``floor`` stands for the smallest score."""

    def found(b):
        for i in range(b.num_rows):
            own = replace(cfg, min_score=b.column(3)[i].as_py()) if floor else cfg
            scores = b.column(1)[i].values
            yield b.column(0)[i].as_py(), peaks_of_scores([] if scores is None else scores.to_numpy(zero_copy_only=False), int(b.column(2)[i].as_py() or 0), own)

    def run(batches):
        for b in batches:
            yield from _batches(key, b.column(0).type, found(b))

    kind = dict(profiles.dtypes)[key]
    return profiles.select(key, F.col(values).cast("array<double>").alias("_v"), F.col(base).cast("long").alias("_b"), *([F.col(floor).cast("double")] if floor else [])).mapInArrow(run, f"`{key}` {kind}, {PEAK_FIELDS}")


def find_bin_peaks(ranked: DataFrame, key: str, cfg: PeaksConfig = PeaksConfig()) -> DataFrame:
    """Peaks of ranked spectrum bins (``key, period, amplitude, peak_rank``), as many a key as were ranked."""

    def run(batches):
        for b in batches:
            yield from _batches(key, b.column(0).type, ((b.column(0)[i].as_py(), peaks_of_bins([(p["period"], p["amplitude"]) for p in b.column(1)[i].as_py()], cfg)) for i in range(b.num_rows)))

    kind = dict(ranked.dtypes)[key]
    lists = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("peak_rank", "period", "amplitude"))).alias("_p"))
    return lists.mapInArrow(run, f"`{key}` {kind}, {PEAK_FIELDS}")


def profile_maxima(df: DataFrame, key: list[str], k: str, score: str) -> DataFrame:
    """Rows strictly above both neighbours; NaN scores and ends never are."""
    along = Window.partitionBy(*key).orderBy(k)
    x = F.col(score)
    flagged = df.withColumn("_p", F.lag(x).over(along)).withColumn("_n", F.lead(x).over(along))
    return flagged.where(~F.isnan(x) & ~F.isnan("_p") & ~F.isnan("_n") & (F.abs(x) < float("inf")) & (x > F.col("_p")) & (x > F.col("_n"))).drop("_p", "_n")


def mad_threshold(df: DataFrame, key: list[str], score: str, factor: float, floor: float) -> DataFrame:
    """``key, median, mad, threshold``: median plus ``factor`` scaled MADs, the floor at least."""
    mid = df.groupBy(*key).agg(F.percentile(score, F.lit(0.5)).alias("median"))
    dev = df.join(mid, key).groupBy(*key).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(score) - F.col("median")), F.lit(0.5)).alias("mad"))
    return dev.withColumn("threshold", F.when(F.col("mad") <= 0, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.col("median") + F.col("mad") * (factor * 1.4826))))


def ratio_number(longer: Column, shorter: Column, tolerance: float, most: int) -> Column:
    """Column form of ``harmonic_number``."""
    ratio = longer / shorter
    n = F.floor(ratio + 0.5)
    return F.when((n >= 2) & (n <= most) & (F.abs(ratio - n) / n <= tolerance), n.cast("long"))
