"""Positions in intervals against a look at every interval."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandlace.operators.intervals import locate
from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums, score_arrays


@pytest.mark.parametrize("width", [1, 7, 1024])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_brute_force(spark, width, how):
    rng = random.Random(width)
    spans = [(g, a, a + rng.choice([0, 1, 5, 40, 900]), f"s{g}{a}") for g in ("x", "y", None) for a in rng.sample(range(3000), 40)]
    probes = [(rng.choice(["x", "y", "z", None]), rng.choice([None, rng.randrange(4500)]), i) for i in range(400)]
    got = locate(spark.createDataFrame(probes, "g string, pos long, id long"), spark.createDataFrame(spans, "g string, start long, stop long, name string"), ["g"], "pos", width, how).collect()
    want = []
    for g, pos, i in probes:
        held = [(s, e, n) for h, s, e, n in spans if g is not None and h == g and pos is not None and s <= pos < e]
        want += [(g, pos, i, *x) for x in held] or ([(g, pos, i, None, None, None)] if how == "left" else [])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_many_probes_of_one_group(spark):
    """A million probes on a hundred thousand records of one group take seconds; a join of all with all would take 10^11 tests."""
    spans = spark.range(100_000).select(F.lit(1).alias("g"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 90).alias("stop"), F.col("id").alias("rec"))
    probes = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 10_000_000).alias("pos"))
    began = time.time()
    got = locate(probes, spans, ["g"], "pos").agg(F.count("rec").alias("n"), F.count("*").alias("all"), F.sum(F.when(F.col("rec") != F.floor(F.col("pos") / 100), 1)).alias("wrong")).first()
    assert got["all"] == 1_000_000 and got["wrong"] is None
    assert got["n"] == sum(1 for i in range(1_000_000) if i * 7919 % 10_000_000 % 100 < 90)
    assert time.time() - began < 60


def test_score_arrays(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ACGT", k=n)) if n is not None else None) for i, n in enumerate([0, 5, 6, 40, 333, None])]
    got = {r["id"]: (r["base"], r["v"]) for r in score_arrays(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", PeriodogramConfig(), 2000).collect()}
    want = {}
    for i, t in rows:
        k, _, s, n = diagonal_sums(PeriodogramConfig().scoring.codes(t or ""), PeriodogramConfig())
        if len(k):
            want[i] = (3, [float(a / b) if b > 0 else 0.0 for a, b in zip(s, n, strict=True)])
    assert got == want
