"""What stored plots hand to the shuffle: whole tiles, not cells."""

import pyarrow as pa

from strandlace.plans.plot_store import TILE, _packed, _tiled


def test_cells_are_packed_by_tile():
    px, py = [5, TILE + 1, 6, TILE - 1, 0], [0, 0, TILE, TILE - 1, 3]
    cells = pa.RecordBatch.from_arrays([pa.array(["a"] * 4 + ["b"]), pa.array(px), pa.array(py), pa.array([1, 2, 3, 255, 9])], names=["plot", "px", "py", "value"])
    (tiled,) = _tiled([cells])
    stored = pa.RecordBatch.from_arrays([*tiled.columns, pa.array(["r"] * 5)], names=[*tiled.schema.names, "run"])
    (packed,) = _packed([stored])
    got = [(r["plot"], r["run"], r["tx"] * TILE + (c >> 18), r["ty"] * TILE + (c >> 8 & TILE - 1), c & 255) for r in packed.to_pylist() for c in r["cells"]]
    assert sorted(got) == sorted(zip("aaaab", "rrrrr", px, py, [1, 2, 3, 255, 9], strict=True))
    assert [(r["plot"], r["tx"], r["ty"], len(r["cells"])) for r in packed.to_pylist()] == [("a", 0, 0, 2), ("a", 1, 0, 1), ("a", 0, 1, 1), ("b", 0, 0, 1)]
