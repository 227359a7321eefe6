"""Range hashes: exact arithmetic, and structured texts on which sums modulo a power of two collide."""

import random

import numpy as np
import pytest
from strandlace.llm import common, substring_dedup
from strandlace.llm.common import RangeHashes

P = (1 << 61) - 1


def test_arithmetic():
    rng = random.Random(1)
    a = [0, 1, P - 1, P - 2, 1 << 60, (1 << 31) - 1, 1 << 31] + [rng.randrange(P) for _ in range(2000)]
    b = [P - 1, P - 1, P - 1, 2, (1 << 60) + 1, 1 << 31, (1 << 31) + 1] + [rng.randrange(P) for _ in range(2000)]
    assert common.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % P for x, y in zip(a, b, strict=True)]
    every = [0, P - 1, P, P + 1, 2 * P, (1 << 64) - 1] + [rng.randrange(1 << 64) for _ in range(500)]
    assert common.reduced(np.array(every, np.uint64)).tolist() == [x % P for x in every]
    for base, inverse in common._BASES:
        assert base * inverse % P == 1
        for n in (0, 1, 2, 5, 1000, 37):
            assert common.powers(base, n).tolist() == [pow(base, i, P) for i in range(n + 1)]


def test_equal_ranges_and_only_those():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0xDEADBEEFCAFEBABE)
    r = RangeHashes(h)
    begin, end = np.triu_indices(401, 1)
    take = rng.permutation(len(begin))[:20_000]
    begin, end = begin[take], end[take]
    key, twin = r.of(begin, end)
    seen: dict = {}
    for b, e, k, t in zip(begin.tolist(), end.tolist(), key.tolist(), twin.tolist(), strict=True):
        assert seen.setdefault((k, t), h[b:e].tobytes()) == h[b:e].tobytes()
    assert len(set(seen.values())) == len(seen)
    # The same symbols elsewhere, in another sequence.
    other = RangeHashes(np.concatenate((rng.integers(0, 1 << 60, 50).astype(np.uint64), h)))
    assert other.of(begin + 50, end + 50)[0].tolist() == key.tolist() and other.of(begin + 50, end + 50)[1].tolist() == twin.tolist()


def test_long_sequences_need_no_kept_powers():
    n = 2 * common._KEPT_POWERS + 77
    h = np.arange(n, dtype=np.uint64) % np.uint64(1000)
    r = RangeHashes(h)
    a, b = r.of(np.array([5, 1005, n - 3000]), np.array([2005, 3005, n - 1000]))
    assert a[0] == a[1] and b[0] == b[1] and (a[2] == a[0]) == ((n - 3000) % 1000 == 5)


@pytest.mark.parametrize("parts", [1, 4])
def test_texts_in_the_order_of_bit_parities(spark, parts):
    """4,096 words that share no window: each sixteenth is one of two words by the parity of a counter's ones, swapped in the other text."""
    parity = lambda i: bin(i).count("1") % 2
    text = lambda swap: " ".join(("x70", "y70")[parity(i // 16) ^ swap] if i % 16 == 0 else f"f{i}" for i in range(4096))
    docs = spark.createDataFrame([(1, text(0)), (2, text(1))], "doc_id long, text string").repartition(parts)
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {0}
