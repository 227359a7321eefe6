"""The dealt-out shuffle null against a serial replay, letter by letter."""

import random

import numpy as np
import pytest

from strandlace.operators import shuffles as S
from strandlace.operators.periodogram import ZERO_SEED, PeriodogramConfig, diagonal_sums

MASK = (1 << 64) - 1


def serial_shuffle(letters: list, state: int) -> tuple[list, int]:
    out = list(letters)
    for i in range(len(out) - 1, 0, -1):
        state ^= state << 13 & MASK
        state ^= state >> 7
        state ^= state << 17 & MASK
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out, state


def serial(text: str, cfg, count: int, seed: int) -> dict:
    codes = cfg.scoring.codes(text)
    k, _, signal, n = diagonal_sums(codes, cfg)
    mean = lambda s: np.where(n > 0, s / np.maximum(n, 1), 0.0)
    state, total, square = seed or ZERO_SEED, np.zeros(len(k)), np.zeros(len(k))
    current = codes.tolist()
    for _ in range(count):
        current, state = serial_shuffle(current, state)
        m = mean(diagonal_sums(np.array(current, np.int64), cfg)[2])
        total += m
        square += m * m
    mu = total / max(count, 1)
    sd = np.sqrt(np.maximum(0.0, square / max(count, 1) - mu * mu))
    m = mean(signal)
    z = np.where(sd > np.finfo(float).eps, (m - mu) / np.where(sd > 0, sd, 1.0), 0.0)
    return {int(a): (float(b), float(c)) for a, b, c in zip(k, m, z, strict=True)}


def test_generator_jumps():
    state = x = 0x123456789ABCDEF
    for i in range(1, 400):
        x = S.step(x)
        if i in (1, 2, 63, 64, 65, 399):
            assert S.ahead(state, i) == x
    assert S.ahead(S.ahead(state, 10**12), 12345) == S.ahead(state, 10**12 + 12345)
    for count in (0, 1, 2, 3, 17, 1000):
        x, want = state, []
        for _ in range(count):
            x = S.step(x)
            want.append(x)
        assert S.draws(state, count).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 333])
def test_permutation(n):
    want, _ = serial_shuffle(list(range(n)), 99)
    assert S.permutation(n, 99).tolist() == want


@pytest.mark.parametrize(("count", "size", "cells"), [(0, 10, 1 << 28), (1, 10, 1 << 28), (7, 3, 1 << 28), (20, 20, 500), (12, 1, 900)])
def test_equals_the_serial_run(spark, count, size, cells):
    rng = random.Random(count)
    rows = [(i, "".join(rng.choices("ACGTN", k=n)) if n is not None else None) for i, n in enumerate([0, 5, 30, 90, 151, None])] + [(7, "ACGTT" * 25), (None, "ACGTTG" * 15)]
    frame = spark.createDataFrame([*rows, rows[3]], "id long, seq string").repartition(4)
    for cfg, seed in ((PeriodogramConfig(), 0), (PeriodogramConfig(window=4, max_offset=20, white=0, black=255), 77)):
        got: dict = {}
        for r in S.shuffle_null(frame, "id", "seq", cfg, count, seed, size, cells).collect():
            assert (r["id"], r["k"]) not in got
            got[(r["id"], r["k"])] = (r["signal_mean"], r["z_score"])
        assert got == {(i, k): v for i, t in rows for k, v in serial(t or "", cfg, count, seed).items()}


def test_bands_of_offsets(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=9000))
    cfg = PeriodogramConfig(min_offset=4000, max_offset=4500)
    got = {r["k"]: (r["signal_mean"], r["z_score"]) for r in S.shuffle_null(spark.createDataFrame([(1, text)], "id long, seq string"), "id", "seq", cfg, 3, 5, 2, 1 << 20).collect()}
    assert len(got) == 501 and got == serial(text, cfg, 3, 5)
