"""Score statistics: lambda, H, K and the window they suggest."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import ascii_upper, letter_count


def match_lambda(same: Column, match: int = 5, mismatch: int = -4) -> Column:
    """Lambda of a match/mismatch scheme where letters agree with probability ``same``: 25 bisection steps; null if the expected score isn't negative."""
    total = lambda x: same * F.exp(x * match) + (1 - same) * F.exp(x * mismatch)
    high = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0.5).cast("double"), lambda u, _: F.when(total(u) < 1, u * 2).otherwise(u))
    start = F.struct(F.lit(0.0).cast("double").alias("lo"), high.alias("hi"))

    def halve(t, _):
        mid = (t["lo"] + t["hi"]) / 2
        over = total(mid) >= 1
        return F.struct(F.when(over, t["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(t["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(25)), start, halve, lambda t: t["lo"])
    return F.when((same > 0) & (same < 1) & (same * match + (1 - same) * mismatch < 0), found)


@dataclass(frozen=True)
class Karlin:
    lam: float
    k: float
    h: float
    expected_residue: float
    expected_msp: float
    predicted: int
    window: int


def karlin(prob: dict[int, float], nominal: int = 100, low: int = 3, high: int = 50) -> Karlin:
    """Statistics of a score distribution; ValueError where they don't exist.

    K is the classic series over sums of independent scores, cut after 20
    terms or once a term is 0.01 or less, and continued geometrically.
    """
    scores = sorted(s for s, p in prob.items() if p > 0)
    if not scores or scores[0] >= 0 or scores[-1] <= 0:
        raise ValueError("scores of both signs must be reachable")
    if sum(s * p for s, p in prob.items()) >= 0:
        raise ValueError("the expected score must be negative")
    s = np.array(scores, float)
    p = np.array([prob[int(x)] for x in scores])
    total = lambda x: float((p * np.exp(x * s)).sum())
    up = 0.5
    while total(up) < 1:
        up *= 2
    lam, hi = 0.0, up
    for _ in range(25):
        mid = (lam + hi) / 2
        lam, hi = (lam, mid) if total(mid) >= 1 else (mid, hi)
    if lam <= 0:  # an expected score of zero that rounding made negative
        raise ValueError("the expected score must be negative")
    tilted = p * np.exp(lam * s)
    per_residue = float((tilted * s).sum())
    if per_residue <= 0:
        raise ValueError("no positive expected score per residue")
    h = lam * per_residue
    k = _series(scores, p, lam, h)
    msp = (math.log(nominal * nominal) + math.log(k)) / lam
    predicted = math.floor(msp / per_residue + 0.5)
    return Karlin(lam, k, h, per_residue, msp, predicted, min(high, max(low, predicted)))


def _series(scores: list[int], p: np.ndarray, lam: float, h: float) -> float:
    lo, hi = scores[0], scores[-1]
    span = math.gcd(*(s - lo for s in scores), lo)
    if lo == -1 or hi == 1:
        mean = float(sum(s * q for s, q in zip(scores, p, strict=True)))
        return (h / lam if hi == 1 else mean * mean / (h / lam)) * (1 - math.exp(-lam))
    one = np.zeros(hi - lo + 1)
    for s, q in zip(scores, p, strict=True):
        one[s - lo] = q
    dist, total, terms = np.ones(1), 0.0, []
    for j in range(1, 21):
        dist = np.convolve(dist, one)
        at = np.arange(len(dist)) + j * lo
        terms.append(float((dist * np.exp(lam * np.minimum(at, 0))).sum()))
        total += terms[-1] / j
        if terms[-1] / j <= 0.01:
            break
    # Later terms are taken to fall geometrically, down to 1e-4.
    ratio = terms[-1] / terms[-2] if len(terms) > 1 else 0.0
    if ratio >= 1 - 1e-5:
        return 0.1
    j, last = len(terms), terms[-1]
    while last / j > 1e-4:
        j, last = j + 1, last * ratio
        total += last / j
    return span * math.exp(-2 * total) / ((h / lam) * -math.expm1(-span * lam))


def auto_pixel_factor(expected_residue: float) -> int:
    return max(1, math.floor(0.2 * 256 / expected_residue + 0.5))


def residue_frequencies(seq: Column, alphabet: str) -> Column:
    """Array of each letter's share of the letters in ``alphabet`` (either case); null without any."""
    text = ascii_upper(seq)
    counts = F.array(*(letter_count(text, c).cast("double") for c in alphabet))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def score_histogram(freqs: DataFrame, key: list[str], matrix: DataFrame) -> DataFrame:
    """``key, score, p``: the distribution of scores of two letters drawn by the frequency arrays ``fq`` and ``fs``; ``matrix`` is a ``ScoreMatrix.frame``."""
    q = freqs.where("fq is not null and fs is not null").select(*key, "fs", F.posexplode("fq").alias("row", "_q")).where("_q > 0")
    both = q.select(*key, "row", "_q", F.posexplode("fs").alias("col", "_s")).where("_s > 0")
    return both.join(F.broadcast(matrix), ["row", "col"]).groupBy(*key, "score").agg(F.sum(F.col("_q") * F.col("_s")).alias("p"))  # 576 rows at most


def letter_karlin(fq: np.ndarray, fs: np.ndarray, table: np.ndarray, nominal: int = 100, low: int = 3, high: int = 50) -> Karlin:
    """Statistics of two sequences' letter frequencies under a score table (rows are subject letters)."""
    prob: dict[int, float] = {}
    joint = np.outer(fs, fq)
    for score in np.unique(table):
        prob[int(score)] = float(joint[table == score].sum())
    return karlin(prob, nominal, low, high)


#: Largest whole number of an int column; lengths and factors of a lambda near zero go beyond it.
_INT = 2**31 - 1
STATISTICS = "lambda double, k double, h double, expected_residue double, expected_msp double, predicted int, window int, pixel_factor int"


def karlin_statistics(freqs: DataFrame, key: list[str], table: list[list[int]], nominal: int = 100, low: int = 3, high: int = 50) -> DataFrame:
    """``key`` and the statistics of each row's frequency arrays ``fq`` and ``fs``; nulls where they don't exist."""
    scores = np.array(table)

    def run(batches):
        for b in batches:
            out = []
            for fq, fs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if fq is None or fs is None:
                        raise ValueError("no letters")
                    s = letter_karlin(np.array(fq), np.array(fs), scores, nominal, low, high)
                    out.append((s.lam, s.k, s.h, s.expected_residue, s.expected_msp, max(-_INT, min(_INT, s.predicted)), s.window, min(_INT, auto_pixel_factor(s.expected_residue))))
                except ValueError:
                    out.append((None,) * 8)
            if out:
                types = [pa.float64()] * 5 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*key, *(x.split()[0] for x in STATISTICS.split(", "))])

    kinds = dict(freqs.dtypes)
    return freqs.select("fq", "fs", *key).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), STATISTICS]))
