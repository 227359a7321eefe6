"""Product codes against a look at every entry."""

import random

import brute
import numpy as np
import pytest
from strandlace.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, q string, n long"


def vectors(seed: int = 4, n: int = 300, dim: int = 24) -> list[tuple]:
    """Clusters, exact ties, a vector that many rows hold, nulls anywhere, short and empty vectors."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(i * 7 % n, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(dim)], 2) for i in range(80)]
    rows += [(1000 + i, centres[0], 3) for i in range(150)]
    rows += [(None, centres[1], None), (5, centres[2], 0), (5, centres[2], 0), (2000, None, 1), (2001, [0.1] * 23 + [None], 1), (2002, [float("nan")] * dim, 1), (2003, [float("-inf")] * dim, 1), (2004, [0.25] * 5, 4), (2005, [], 4), (2006, [-1e-9] * dim, 4)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", "q", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("rows", [vectors(), vectors(5, 9, 8), [(3, [1.5] * 8, None)] * 4, [(1, [], 0)]], ids=["mixed", "few", "repeats", "empty vector"])
def test_equals_brute_force(spark, rows):
    coded, books = vc.compress(table(spark, rows))
    got = coded.collect()
    want, entries = brute.codes(rows)
    by_label: dict = {}
    for _, lab, _, e in want:
        by_label[lab] = by_label.get(lab, 0) + e
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["vec_id"], None if r["label"] is None else int(r["label"]), r["code"], r["error"], r["label_error"]) for r in got], key=key) == sorted([(i, lab, c, e, by_label[lab]) for i, lab, c, e in want], key=key)
    assert books.entries.tolist() == entries


def test_no_vectors(spark):
    for rows in (vectors()[:1], [(1, None, 2), (2, [float("inf")], None)]):
        coded, books = vc.compress(table(spark, rows).where("vec_id <> 0 or embedding is null"))
        assert coded.count() == 0 and books is None


def test_extreme_components_stay_within_a_long(spark):
    rows = [(i, [x] * 16, 0) for i, x in enumerate([1e30, -1e30, 3e38, 0.0, 1.0, -1.0])]
    coded, _ = vc.compress(table(spark, rows), size=2)
    assert all(0 <= r["error"] < 2**63 and 0 <= r["label_error"] < 2**63 for r in coded.collect())


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    width = [1, 3, 8, 8, 2, 16][seed]
    entries = rng.integers(-50, 50, (40 if seed % 2 else 16, width)) * (10 ** (seed % 4))
    if seed == 3:
        entries[5:9] = entries[4]
    parts = np.concatenate((entries, entries[rng.integers(0, len(entries), 500)] + rng.integers(-3, 4, (500, width)), (entries[:10] + entries[1:11]) // 2))
    seen: list = []
    at, d = vc.nearest(vc.plant(entries), entries, parts, seen)
    all_d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (at == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
    assert sum(seen) < len(entries) * len(parts)


def test_codes_stand_for_vectors(spark):
    rows = vectors(8, 200, 16)
    coded, books = vc.compress(table(spark, rows))
    real = {i: v for i, v, _ in rows if v is not None and len(v) == 16 and i not in (None, 5) and all(x is not None and np.isfinite(x) for x in v)}
    for r in coded.where("vec_id in (1, 17, 90, 1003)").collect():
        off = np.floor(np.array(real[r["vec_id"]]) * 4096) - books.vector(r["code"]) * 4096
        assert int((off**2).sum()) == r["error"]
