"""Many diagonals at a time against one after the other, and periodograms that come in few batches."""

import random

import numpy as np
import pytest

from strandlace.operators import periodogram as P
from strandlace.operators.kernel import Scoring


def one_by_one(codes, cfg, ks):
    score = P.scorer(cfg, True)
    out = [score(codes[k + 1 :], codes[1 : len(codes) - k]) if k < len(codes) - cfg.window else (0, 0) for k in ks.tolist()]
    return [x for x, _ in out], [x for _, x in out]


@pytest.mark.parametrize("cfg", [P.PeriodogramConfig(), P.PeriodogramConfig(max_offset=12), P.PeriodogramConfig(window=9, min_offset=1, max_offset=400), P.PeriodogramConfig(window=1, factor=30, min_offset=0), P.PeriodogramConfig(window=5, white=0, black=255, scoring=Scoring(alphabet="ACGTN"))], ids=["half", "band", "nine", "one", "five letters"])
def test_bits_equal_letters(cfg, monkeypatch):
    rng = random.Random(3)
    calls = []
    bits = P._bit_sums
    monkeypatch.setattr(P, "_bit_sums", lambda x, ks, c: calls.append(len(ks)) or bits(x, ks, c))
    monkeypatch.setattr(P, "_BIT_BYTES", 100)
    for n in (0, 1, 7, 8, 9, 10, 17, 63, 64, 65, 129, 513):
        for letters in (cfg.scoring.alphabet, "AC", "A"):
            codes = cfg.scoring.codes("".join(rng.choices(letters, k=n)))
            ks, raw, signal, _ = P.diagonal_sums(codes, cfg)
            assert (raw.tolist(), signal.tolist()) == one_by_one(codes.astype(np.uint8), cfg, ks)
    # The fast way is taken, once for all offsets of a record.
    assert len(calls) >= 18 and max(calls) > 9


def test_records_share_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ACGT" * 20 + "A" * (i % 7)) for i in range(300)], "id int, seq string").coalesce(1)
    cfg = P.PeriodogramConfig(max_offset=12)
    out = P.periodogram(rows, "id", "seq", cfg, ["seq"])
    sizes = out.mapInArrow(lambda bs: (b.slice(0, 1).select(["k"]) for b in bs), "k long").count()
    assert out.count() == 3000 and sizes == 1
    assert all(r["id"] % 7 == len(r["seq"]) - 80 for r in out.collect())
