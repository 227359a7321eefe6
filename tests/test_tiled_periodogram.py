"""Periodograms from cells of positions against the sums of whole records."""

import random

import pytest

from strandlace.operators.kernel import Scoring
from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums, periodogram, periodogram_profiles
from strandlace.operators.tiled_periodogram import cells_of_chunks, cells_of_records, tiled_periodogram
from strandlace.sources.fasta_chunks import read_fasta_chunks


def records(letters: str, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, "".join(rng.choices(letters, k=n)) if n is not None else None) for i, n in enumerate([0, 1, 7, 8, 9, 20, 63, 64, 65, 200, 513, None])] + [(20, (letters[:5] * 60)[:288]), (21, letters[0] * 150)]


def expected(rows, cfg):
    return {(i, int(k)): (int(r), int(s), int(n)) for i, t in rows for k, r, s, n in zip(*diagonal_sums(cfg.scoring.codes(t or ""), cfg), strict=True)}


def content(frame, key="id"):
    rows = frame.collect()
    got = {(r[key], r["k"]): (r["raw_sum"], r["signal_sum"], r["n_pairs"]) for r in rows}
    assert len(got) == len(rows)
    return got



@pytest.mark.parametrize("cfg", [PeriodogramConfig(), PeriodogramConfig(max_offset=12), PeriodogramConfig(window=5, min_offset=1, max_offset=300), PeriodogramConfig(window=1, factor=30)], ids=["half", "band", "beyond", "window 1"])
@pytest.mark.parametrize(("size", "run"), [(16, 2), (64, 1), (1 << 16, 8)])
def test_equals_whole_records(spark, cfg, size, run):
    for letters in ("ACGT", "ACGTN"):
        rows = records(letters)
        frame = spark.createDataFrame(rows, "id long, seq string").repartition(4)
        assert content(tiled_periodogram(cells_of_records(frame, "id", "seq", cfg, size), "id", cfg, size, run)) == expected(rows, cfg)


def test_scores_that_differ_by_direction(spark):
    table = tuple(tuple((3 * i - 2 * j + 1) % 7 - 3 for j in range(4)) for i in range(4))
    cfg = PeriodogramConfig(scoring=Scoring(table=table))
    rows = records("ACGT", 5)
    frame = spark.createDataFrame(rows, "id long, seq string")
    want = expected(rows, cfg)
    assert content(tiled_periodogram(cells_of_records(frame, "id", "seq", cfg, 32), "id", cfg, 32)) == want
    assert content(periodogram(frame, "id", "seq", cfg)) == want


def test_records_that_never_were_one_row(spark, tmp_path):
    rows = [(i, t) for i, t in records("ACGT", 3) if t]
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{t[:40]}\n{t[40:]}\n" for i, t in rows))
    cfg = PeriodogramConfig()
    chunks = read_fasta_chunks(spark, str(tmp_path), 23).withColumnRenamed("record_idx", "id")
    want = expected([(j, t) for j, (_, t) in enumerate(rows)], cfg)
    for size in (16, 100):
        assert content(tiled_periodogram(cells_of_chunks(chunks, "id", cfg, size), "id", cfg, size, 2)) == want


def test_profiles_as_arrays(spark):
    cfg = PeriodogramConfig(max_offset=12)
    rows = records("ACGT", 4)
    got = periodogram_profiles(spark.createDataFrame(rows, "id long, seq string"), "seq", cfg, ["id"]).collect()
    want = expected(rows, cfg)
    for r in got:
        if r["id"] == 11:
            assert r["profile"] is None
        else:
            assert {(r["id"], p["k"]): (p["raw_sum"], p["signal_sum"], p["n_pairs"]) for p in r["profile"]} == {k: v for k, v in want.items() if k[0] == r["id"]}
    with pytest.raises(ValueError, match="max_offset"):
        periodogram_profiles(spark.createDataFrame(rows, "id long, seq string"), "seq", PeriodogramConfig(), ["id"])
