"""Periodograms of records of any length: cells of positions, tiles of two cells, sums added by Spark.

A record is cut into cells of ``size`` letters, each with the ``window - 1``
letters before it, so that every window lies in one cell.  A tile is a pair of
cells (i, j) of one record: all places of cell j against all places of cell i,
that is the offsets around (j - i) * size.  A tile's sums are partial
vectors over two cells of offsets; tiles of one distance that meet in a task are
added there, and the rest is added after a shuffle by (record, cell of offsets).
No task holds a record, and records may come as chunks that never were one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .periodogram import PeriodogramConfig, known, scorer

#: Letters of a cell, and neighbouring tiles of one distance that one task adds up.
CELL, RUN = 1 << 16, 8


def cells_of_records(records: DataFrame, key: str, seq: str, cfg: PeriodogramConfig, size: int = CELL) -> DataFrame:
    """``key, n, cell, start, letters`` of whole sequences (null counts as empty)."""
    text, halo = F.coalesce(F.col(seq), F.lit("")), cfg.window - 1
    rows = records.select(key, text.alias("_t"), F.length(text).cast("long").alias("n"))
    rows = rows.select(key, "n", "_t", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / size)))).alias("cell"))
    start = F.greatest(F.lit(0), F.col("cell") * size - halo)
    stop = F.least("n", (F.col("cell") + 1) * size)
    return rows.select(key, "n", "cell", start.alias("start"), F.substr("_t", (start + 1).cast("int"), (stop - start).cast("int")).alias("letters"))


def cells_of_chunks(chunks: DataFrame, key: str, cfg: PeriodogramConfig, size: int = CELL) -> DataFrame:
    """The same cells from chunks ``key, start, letters`` of records; a cell gathers ``size + window - 1`` letters at most."""
    halo, width = cfg.window - 1, F.length("letters")
    own = chunks.select(key, F.col("start").cast("long").alias("_at"), "letters", width.cast("long").alias("_w"))
    lengths = own.groupBy(key).agg(F.max(F.col("_at") + F.col("_w")).alias("n"))
    last = F.floor((F.col("_at") + F.col("_w") - 1 + halo) / size)
    parts = own.where("_w > 0").select("*", F.explode(F.sequence(F.floor(F.col("_at") / size), last)).alias("cell"))
    low = F.greatest(F.col("_at"), F.greatest(F.lit(0), F.col("cell") * size - halo))
    high = F.least(F.col("_at") + F.col("_w"), (F.col("cell") + 1) * size)
    cut = parts.select(key, "cell", low.alias("start"), F.substr("letters", (low - F.col("_at") + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int")).alias("letters"))
    cells = cut.where("letters <> ''").groupBy(key, "cell").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "letters"))).alias("_c"))
    joined = cells.select(key, "cell", "start", F.array_join(F.transform("_c", lambda c: c["letters"]), "").alias("letters")).join(lengths, key)
    # The letters before a cell may reach into a cell that holds nothing else.
    return joined.where(F.col("cell") * size < F.col("n")).select(key, "n", "cell", "start", "letters")


def _offsets(cfg: PeriodogramConfig, n: int, cell: int, size: int) -> np.ndarray:
    """The offsets of a record of ``n`` letters that lie in a cell of offsets; vectors have an entry for each."""
    top = n // 2 if cfg.max_offset is None else cfg.max_offset
    return np.arange(max(cfg.min_offset, cell * size), min(top, (cell + 1) * size - 1) + 1)


def _tiles(cfg: PeriodogramConfig, size: int, key: str):
    w = cfg.window

    def run(batches):
        """Rows come by (record, distance, run, tile, role): the two cells of a tile one after the other."""
        now = first = kind = None
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told():
            at = sorted(sums)
            rows = [pa.array([now[0]] * len(at), kind), pa.array([now[3]] * len(at), pa.int64()), pa.array(at, pa.int64()), *(pa.array([sums[c][x][_offsets(cfg, now[3], c, size) - c * size] for c in at], pa.list_(pa.int64())) for x in (0, 1))]
            sums.clear()
            return pa.RecordBatch.from_arrays(rows, names=[key, "n", "k_cell", "raw", "signal"])

        for b in batches:
            kind = b.schema.field(0).type
            for i in range(b.num_rows):
                owner, n, band, group, q_cell, role, start, letters = (c[i].as_py() for c in b.columns)
                if (owner, band, group, n) != now:
                    if sums:
                        yield told()
                    now = (owner, band, group, n)
                side = q_cell, start, cfg.scoring.codes(letters)
                if role == 0:
                    first = side
                elif first is not None and first[0] == q_cell:
                    _add(sums, first, side, band, n)

        if sums:
            yield told()

    def _add(sums, first, second, band, n):
        (cell, a_at, a), (_, b_at, b) = first, second
        plain = known(a, cfg) and known(b, cfg)
        score = scorer(cfg, plain)
        if plain:
            a, b = a.astype(np.uint8), b.astype(np.uint8)
        q0, s0, a_end, b_end = cell * size, (cell + band) * size, a_at + len(a), b_at + len(b)
        top = n // 2 if cfg.max_offset is None else cfg.max_offset
        for k in range(max(cfg.min_offset, (band - 1) * size + 1), min(top, (band + 1) * size - 1) + 1):
            low, high = max(q0, s0 - k, w), min(a_end, b_end - k)  # ends of windows in the query; a diagonal's first is left out
            if low >= high:
                continue
            raw, signal = score(b[low + k - w + 1 - b_at : high + k - b_at], a[low - w + 1 - a_at : high - a_at])
            held = sums.setdefault(k // size, (np.zeros(size, np.int64), np.zeros(size, np.int64)))
            held[0][k % size] += raw
            held[1][k % size] += signal

    return run


def _added(cfg: PeriodogramConfig, size: int, key: str):
    def run(batches):
        """Vectors of one (record, cell of offsets) are added as they stream."""
        now, held, kind = None, [None, None], None

        def told():
            owner, n, cell = now
            ks = _offsets(cfg, n, cell, size)
            if not len(ks):
                return None
            fields = [np.zeros(len(ks), np.int64) if h is None else h for h in held]
            return pa.RecordBatch.from_arrays([pa.array([owner] * len(ks), kind), *(pa.array(x, pa.int64()) for x in (ks, *fields, np.maximum(0, n - cfg.window - ks)))], names=[key, "k", "raw_sum", "signal_sum", "n_pairs"])

        for b in batches:
            kind = b.schema.field(0).type
            for i in range(b.num_rows):
                owner, n, cell = (c[i].as_py() for c in b.columns[:3])
                if (owner, n, cell) != now:
                    if now is not None and (out := told()) is not None:
                        yield out
                    now, held = (owner, n, cell), [None, None]
                for x in (0, 1):
                    part = b.column(3 + x)[i].values
                    if part is not None and len(part):
                        held[x] = part.to_numpy() if held[x] is None else held[x] + part.to_numpy()
        if now is not None and (out := told()) is not None:
            yield out

    return run


def tiled_periodogram(cells: DataFrame, key: str, cfg: PeriodogramConfig = PeriodogramConfig(), size: int = CELL, run: int = RUN) -> DataFrame:
    """``key, k, raw_sum, signal_sum, n_pairs``: the rows of ``periodogram``, from cells of records; ``key`` names a record and is not null."""
    if cfg.window is None or not cfg.factor:
        raise ValueError("cells need a window and a pixel factor")
    kind = dict(cells.dtypes)[key]
    top = F.floor(F.col("n") / 2) if cfg.max_offset is None else F.lit(cfg.max_offset).cast("long")
    reach = F.greatest(F.lit(0), F.floor((top - 1) / size) + 1)  # the farthest cell that an offset leads to
    last = F.floor((F.col("n") - 1) / size)
    cell = F.col("cell")
    as_query = cells.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(reach, last - cell))).alias("band"), cell.alias("q_cell"), F.lit(0).alias("role"))
    as_subject = cells.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(reach, cell))).alias("band"), (cell - F.col("band")).alias("q_cell"), F.lit(1).alias("role"))
    sides = as_query.unionByName(as_subject).withColumn("run", F.floor(F.col("q_cell") / run))
    order = [key, "n", "band", "run", "q_cell", "role"]
    dealt = sides.select(*order, "start", "letters").repartition(key, "band", "run").sortWithinPartitions(*order)
    partial = dealt.mapInArrow(_tiles(cfg, size, key), f"`{key}` {kind}, n long, k_cell long, raw array<long>, signal array<long>")
    none = F.lit(None).cast("array<long>")
    dense = cells.where("cell = 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor(top / size)))).alias("k_cell"), none.alias("raw"), none.alias("signal"))
    gathered = partial.unionByName(dense).repartition(key, "k_cell").sortWithinPartitions(key, "n", "k_cell")
    return gathered.mapInArrow(_added(cfg, size, key), f"`{key}` {kind}, k long, raw_sum long, signal_sum long, n_pairs long")
