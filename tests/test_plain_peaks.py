"""Peaks against the plain replay: random profiles, ties, ladders, and the registered queries."""

import os
import random

import numpy as np
import plain_peaks
import pytest

from strandlace.operators import peaks as K
from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums
from strandlace.operators.spectrum import rank_peaks
from strandlace.plans.catalogue import QUERIES
from strandlace.plans.catalogue import _hourly as _hourly_spectra
from strandlace.sources.tables import display_order


def profile(rng: random.Random, n: int) -> list[float]:
    """Noise, ladders of a few periods with jitter and gaps, and equal scores."""
    x = [rng.choice([0.0, 1.0, rng.random() * 4]) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        period, height = rng.randrange(4, 40), rng.choice([20.0, 12.5, 30.0])
        for m in range(1, 40):
            at = period * m + rng.choice([0, 0, 0, 1, -1]) - 3
            if 0 < at < n and rng.random() < 0.8:
                x[at] = height if rng.random() < 0.5 else height / m + rng.random()
    return x


def told(found) -> list[tuple]:
    return sorted(((p.period, p.score, p.kind, p.parent, p.n, p.divisor, len(p.ladder) if p.kind == "fundamental" else None, sorted(p.ladder)) for p in found), key=repr)


@pytest.mark.parametrize("seed", range(60))
def test_profiles(seed):
    rng = random.Random(seed)
    x = profile(rng, rng.choice([5, 60, 300]))
    least, harmonics, boundary, sub = rng.choice([1.0, 3.0, 10.0]), rng.choice([0, 1, 3]), rng.choice([0.9, 1.0, 0.5]), rng.choice([None, 0.5, 5.0])
    cfg = K.PeaksConfig(min_score=least, min_harmonics=harmonics, boundary_fraction=boundary, subrepeat_min_score=sub)
    got = K.peaks_of_scores(np.array(x), 3, cfg)
    assert told(got) == sorted(plain_peaks.profile_peaks(x, 3, least, harmonics, boundary, sub), key=repr)
    assert [p.score for p in got] == sorted((p.score for p in got), reverse=True)


@pytest.mark.parametrize("seed", range(40))
def test_spectra(seed):
    rng = random.Random(seed)
    periods = {512 / b: rng.choice([5.0, 9.0, rng.random() * 20]) for b in rng.sample(range(1, 200), 25)}
    got = K.peaks_of_bins(list(periods.items()), K.PeaksConfig(min_score=2.0, min_harmonics=0))
    want = plain_peaks.classify([(p, s) for p, s in periods.items() if s >= 2.0], falling=True)
    assert {p.period: (p.kind, p.parent, p.n, sorted(p.ladder)) for p in got} == want


def documents(spark, tmp_path) -> list[tuple]:
    rng = random.Random(5)
    unit = "".join(rng.choices("ACGT", k=60))
    rows = [(1, unit * 9), (2, "ACGTT" * 60), (3, (unit[:20] * 2 + unit[20:53]) * 7), (4, "".join(rng.choices("ACGT", k=300))), (5, "ACG"), (6, "xyz"), (7, "ACGACGACT" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_registered_query(spark, tmp_path):
    rows = documents(spark, tmp_path)
    want = []
    for i, text in rows:
        codes = PeriodogramConfig().scoring.codes("".join(c for c in text.upper() if c in "ACGT"))
        k, _, s, n = diagonal_sums(codes, PeriodogramConfig())
        if len(k):
            x = [float(a / b) if b > 0 else 0.0 for a, b in zip(s, n, strict=True)]
            want += [(i, *r) for r in plain_peaks.profile_peaks(x, 3, 5.0, 0, 0.9, 5.0)]
    got = [tuple(r) for r in QUERIES["peaks_classified"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 20
    assert QUERIES["peaks_table"](spark, str(tmp_path)).count() == len(got)
    subs = {tuple(r) for r in QUERIES["peaks_subrepeats"](spark, str(tmp_path)).collect()}
    assert subs == {(r[0], r[1], r[2], r[4], r[6]) for r in want if r[3] == "subrepeat"} and subs
    # Fundamentals by score, each followed by its sub-repeats, then harmonics.
    shown = display_order(QUERIES["peaks_classified"](spark, str(tmp_path)), "doc_id", None, True).collect()
    for i in {r["doc_id"] for r in shown}:
        mine = sorted((r for r in shown if r["doc_id"] == i), key=lambda r: r["row"])
        assert [r["row"] for r in mine] == list(range(1, len(mine) + 1))
        lead = [r["score"] for r in mine if r["kind"] == "fundamental"]
        assert lead == sorted(lead, reverse=True)
        kinds = [r["kind"] for r in mine]
        assert "harmonic" not in kinds or set(kinds[kinds.index("harmonic") :]) == {"harmonic"}
        last = None
        for r in mine:
            last = r["period"] if r["kind"] == "fundamental" else last
            assert r["kind"] != "subrepeat" or r["parent"] == last


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_spectra_of_events(spark):
    sf = "/root/testdata/sf0.001"
    ranked = rank_peaks(_hourly_spectra(spark, sf), "key", 20).collect()
    by: dict = {}
    for r in ranked:
        by.setdefault(r["key"], []).append((r["period"], r["amplitude"]))
    want = sorted((repr(k), p, *v[:3]) for k, c in by.items() for p, v in plain_peaks.classify(c, falling=True).items())
    got = sorted((repr(r["key"]), r["period"], r["kind"], r["parent"], r["harmonic_n"]) for r in QUERIES["peaks_of_spectrum"](spark, sf).collect())
    assert list(map(repr, got)) == list(map(repr, want))
