"""Alignments read an excerpt, not the whole text, for each letter."""

import time

from pyspark.sql import functions as F

from strandlace.functions import sequence as Q
from strandlace.operators.kernel import Scoring


def test_places_in_and_outside(spark):
    texts = ["", "A", "ACGTACGTTGCA", None]
    rows = [(a, b, i, j) for a in texts for b in texts for i in (-40, -3, 0, 5, 11, 12, 90) for j in (-2, 0, 7, 60)]
    frame = spark.createDataFrame(rows, "a string, b string, i int, j int")
    both = [Q.alignment_columns(F.col("a"), F.col("b"), F.col("i"), F.col("j"), 7, Scoring(), r) for r in (False, True)]
    turn = {"A": "T", "C": "G", "G": "C", "T": "A"}
    for r in frame.select("*", *(c.alias(n) for c, n in zip(both, "fr", strict=True))).collect():
        at = lambda t, p: t[p] if t is not None and 0 <= p < len(t) else None
        for name in "fr":
            for k, x in enumerate(r[name]):
                q, s = at(r["a"], r["i"] - 3 + k), at(r["b"], r["j"] + (3 - k if name == "r" else k - 3))
                s = turn[s] if s and name == "r" else s
                kind = "OutOfBounds" if q is None or s is None else "Identical" if q == s else "Other"
                assert (x["q"], x["s"], x["class"], x["score"]) == (q or "-", s or "-", kind, {"OutOfBounds": 0, "Identical": 5, "Other": -4}[kind])


def test_long_texts(spark):
    frame = spark.range(0, 40, 1, 2).select(F.repeat(F.lit("ACGTTGCA"), 250_000).alias("a"))
    text = Q.clipboard_text(F.col("a"), F.col("a"), F.lit(999_999), F.lit(1_000_003), 31, Scoring(), True)
    began = time.time()
    assert frame.select(F.length(text).alias("n")).distinct().count() == 1
    # Each letter by itself walked two million letters, some hundred times a row.
    assert time.time() - began < 60
