"""Partial vectors of cells hold the offsets asked for, not a whole cell."""

import pyarrow as pa

from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums
from strandlace.operators.tiled_periodogram import _tiles


def test_vectors_are_as_long_as_their_offsets():
    cfg, text = PeriodogramConfig(max_offset=12), "ACGTTGCAAC" * 20
    row = [1, len(text), 0, 0, 0, 0, 0, text]
    cols = [pa.array([v, v]) for v in row]
    cols[5] = pa.array([0, 1])
    out = list(_tiles(cfg, 1000, "id")([pa.RecordBatch.from_arrays(cols, names=["id", "n", "band", "run", "q_cell", "role", "start", "letters"])]))
    k, raw, signal, _ = diagonal_sums(cfg.scoring.codes(text), cfg)
    assert [r for b in out for r in b.to_pylist()] == [{"id": 1, "n": 200, "k_cell": 0, "raw": raw.tolist(), "signal": signal.tolist()}] and len(k) == 10
