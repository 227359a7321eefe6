"""Shuffle nulls of periodograms, dealt out over tasks.

The shuffles of a record are cumulative, and all draw from one xorshift64
stream.  The generator is linear over GF(2), so its state any number of steps
ahead is a product of powers of its step matrix: a task starts at its own
shuffle without the draws before it.  A shuffle is a permutation of places, so
shuffles compose: each block of shuffles gives one permutation, the prefix
products of these give the letters with which every block starts, and the blocks'
periodograms are then independent.  Sums of the means run in the order of the
shuffles, so the result is that of a serial run to the last bit.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import spread
from .periodogram import PART_CELLS, ZERO_SEED, PeriodogramConfig, diagonal_sums, settled

_MASK = (1 << 64) - 1
#: Offsets that one vector of sums covers.
BAND = 1 << 12


def step(x):
    """One step of xorshift64 with the shifts 13, 7, 17; of a number or of an array."""
    if isinstance(x, np.ndarray):
        x = x ^ (x << np.uint64(13))
        x = x ^ (x >> np.uint64(7))
        return x ^ (x << np.uint64(17))
    x ^= x << 13 & _MASK
    x ^= x >> 7
    return x ^ (x << 17 & _MASK)


def _apply(matrix: tuple[int, ...], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= matrix[low.bit_length() - 1]
        x ^= low
    return out


@cache
def _power(i: int) -> tuple[int, ...]:
    """The step matrix to the power 2^i, as the images of single bits."""
    if i == 0:
        return tuple(step(1 << b) for b in range(64))
    half = _power(i - 1)
    return tuple(_apply(half, x) for x in half)


def ahead(state: int, steps: int) -> int:
    """The state after ``steps`` steps."""
    i = 0
    while steps:
        if steps & 1:
            state = _apply(_power(i), state)
        steps >>= 1
        i += 1
    return state


def draws(state: int, count: int) -> np.ndarray:
    """The next ``count`` states: lanes a stride apart, stepped together."""
    lanes = max(1, int(count**0.5))
    stride = -(-count // lanes) if count else 0
    starts = [state]
    for _ in range(lanes - 1):
        starts.append(ahead(starts[-1], stride))
    x, out = np.array(starts, np.uint64), np.empty((stride, lanes), np.uint64)
    for i in range(stride):
        x = out[i] = step(x)
    return out.T.ravel()[:count]


def permutation(n: int, state: int) -> np.ndarray:
    """Places after one Fisher-Yates shuffle from the end: shuffled letters are ``letters[permutation]``."""
    places = list(range(n))
    if n > 1:
        for i, j in zip(range(n - 1, 0, -1), (draws(state, n - 1) % np.arange(n, 1, -1, dtype=np.uint64)).tolist(), strict=True):
            places[i], places[j] = places[j], places[i]
    return np.array(places, np.int32)


def _block(n: int, seed: int, first: int, count: int):
    """The permutations of shuffles ``first`` to ``first + count - 1`` of a record of n letters."""
    each = max(0, n - 1)
    state = ahead(seed or ZERO_SEED, first * each)
    for _ in range(count):
        yield permutation(n, state)
        state = ahead(state, each)


def _blocks(seed: int, shuffles: int, size: int):
    def run(batches):
        """One permutation for each block: the product of its shuffles'."""
        for b in batches:
            for i in range(b.num_rows):
                n, block = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                order = np.arange(n, dtype=np.int32)
                for p in _block(n, seed, block * size, min(size, shuffles - block * size)):
                    order = order[p]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([block + 1]), pa.nulls(1, pa.string()), pa.array([order], pa.list_(pa.int32()))], names=[b.schema.names[0], "sid", "block", "seq", "order"])

    return run


def _starts(batches):
    """The letters with which each block starts: prefix products, streamed record by record; repeated rows count once."""
    now, at, letters = None, -1, b""
    for b in batches:
        for i in range(b.num_rows):
            owner, block = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
            if owner != now:
                now, at = owner, -1
                letters = np.frombuffer(b.column(3)[i].as_py().encode("latin-1", "replace"), np.uint8)
            elif block == at:
                continue
            else:
                letters = letters[b.column(4)[i].values.to_numpy()]
            at = block
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([block]), pa.array([letters.tobytes().decode("latin-1")])], names=[b.schema.names[0], "sid", "block", "seq"])


def _scored(cfg: PeriodogramConfig, seed: int, shuffles: int, size: int):
    def run(batches):
        """Signal sums of a block's shuffles over one range of offsets, cut into bands; the record's own sums are block -1."""
        for b in batches:
            for i in range(b.num_rows):
                block, text, part, parts = (b.column(c)[i].as_py() for c in range(2, 6))
                codes = cfg.scoring.codes(text)
                own = settled(codes, cfg)  # a shuffle keeps the counts of letters, so all have the record's own
                if own is None:
                    continue
                first = block * size
                sets = [(-1, [codes])] if block == 0 else []
                current, later = codes, []
                for p in _block(len(codes), seed, first, min(size, shuffles - first)):
                    current = current[p]
                    later.append(current)
                for name, group in [*sets, (block, later)]:
                    found = [diagonal_sums(c, own, (part, parts)) for c in group]
                    if not found or not len(found[0][0]):
                        continue
                    ks, n = found[0][0], found[0][3]
                    sums = np.stack([f[2] for f in found])
                    # Bands lie on one grid for all parts.
                    for cell in range(int(ks[0]) // BAND, int(ks[-1]) // BAND + 1):
                        mine = (ks >= cell * BAND) & (ks < (cell + 1) * BAND)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([cell], pa.int64()), pa.array([int(part)]), pa.array([name], pa.int64()), pa.array([ks[mine]], pa.list_(pa.int64())), pa.array([n[mine]], pa.list_(pa.int64())), pa.array([sums[:, mine].ravel()], pa.list_(pa.int64()))], names=[b.schema.names[0], "sid", "band", "part", "block", "k", "n", "sums"])

    return run


def _scores(shuffles: int):
    def run(batches):
        """z-scores of one band of a record: its rows come in the order of the shuffles."""
        now = kind = None

        def told():
            mu = total / max(shuffles, 1)
            sd = np.sqrt(np.maximum(0.0, square / max(shuffles, 1) - mu * mu))
            z = np.where(sd > np.finfo(float).eps, (own - mu) / np.where(sd > 0, sd, 1.0), 0.0)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(ks), kind), pa.array(ks), pa.array(own), pa.array(z)], names=[name, "k", "signal_mean", "z_score"])

        for b in batches:
            kind, name = b.schema.field(0).type, b.schema.names[0]
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in range(4))
                sums, n = b.column(7)[i].values.to_numpy(), b.column(6)[i].values.to_numpy()
                means = np.where(n > 0, sums.reshape(-1, len(n)) / np.maximum(n, 1), 0.0)
                if key != now:
                    if now is not None:
                        yield told()
                    now, ks, own = key, b.column(5)[i].values.to_numpy(), means[0]
                    total, square = np.zeros(len(n)), np.zeros(len(n))
                    continue
                for m in means:
                    total = total + m
                    square = square + m * m
        if now is not None:
            yield told()

    return run


def shuffle_null(records: DataFrame, key: str, seq: str, cfg: PeriodogramConfig, shuffles: int, seed: int, size: int = 10, part_cells: int = PART_CELLS) -> DataFrame:
    """``key, k, signal_mean, z_score`` of each record against cumulative shuffles of its letters.

    Blocks of ``size`` shuffles, and ranges of ``part_cells`` cells of offsets in
    them, are dealt out over tasks.  ``seed`` 0 stands for a fixed state.
    Repeated rows count once; a null sequence is empty; a record without an
    offset in range gives no rows.
    """
    kind = dict(records.dtypes)[key]
    text = F.coalesce(F.col(seq), F.lit(""))
    rows = records.select(key, F.xxhash64(text).alias("sid"), text.alias("seq")).dropDuplicates([key, "sid"])
    count = max(1, -(-shuffles // size))
    named = f"`{key}` {kind}, sid long, block long"
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 2).cast("long"))).alias("block")
    lead = rows.select(key, "sid", F.lit(0).cast("long").alias("block"), "seq", F.lit(None).cast("array<int>").alias("order"))
    if count > 1:
        jobs = spread(rows.select(key, "sid", F.length("seq").alias("n"), block), [key, "sid", "block"])
        lead = lead.unionByName(jobs.mapInArrow(_blocks(seed, shuffles, size), f"{named}, seq string, order array<int>"))
    starts = lead.repartition(key, "sid").sortWithinPartitions(key, "sid", "block").mapInArrow(_starts, f"{named}, seq string")
    cells = F.length("seq").cast("double")
    offsets = F.floor(cells / 2) if cfg.max_offset is None else F.lit(float(cfg.max_offset))
    parts = F.greatest(F.lit(1), F.least(F.ceil(cells * offsets / part_cells), offsets)).cast("int")
    tasks = starts.withColumn("parts", parts).select(key, "sid", "block", "seq", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    sums = spread(tasks, [key, "sid", "block", "part"]).mapInArrow(_scored(cfg, seed, shuffles, size), f"`{key}` {kind}, sid long, band long, part long, block long, k array<long>, n array<long>, sums array<long>")
    ordered = sums.repartition(key, "sid", "band", "part").sortWithinPartitions(key, "sid", "band", "part", "block")
    return ordered.mapInArrow(_scores(shuffles), f"`{key}` {kind}, k long, signal_mean double, z_score double")
