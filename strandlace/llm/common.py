"""Shared pieces of the training-data operators.

Document identity.  A document is the pair ``(did, th)``: the integer id (null
ids count as the smallest long) and XXH64 of the text.  Rows that agree in both
are the same document repeated and always get the same result; rows that share
only the id stay apart.  The pair is content-based, so a task that runs again
after an executor is lost makes the same rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: U+0020 and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
NO_ID = -(2**63)
#: Text bytes that one vectorised step of a Python worker holds at most (a single longer text is a step alone).
STEP_BYTES = 4 << 20

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_PHI = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised; ``salt`` selects the function."""
    with np.errstate(over="ignore"):
        z = x.astype(_U, copy=False) + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> _U(30))) * _M1
        z = (z ^ (z >> _U(27))) * _M2
        return z ^ (z >> _U(31))


#: Range hashes are polynomials modulo this prime: sums modulo a power of two collide on structured texts whatever their multiplier.
_P = _U((1 << 61) - 1)
#: Bases of the two lanes, their inverses, and how many of their powers a worker keeps.
_BASES = tuple((b, pow(b, -1, int(_P))) for b in (0x0F3B4D1C6A5E9387, 0x1A9C2F7E50B86D43))
_KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, from 31-bit halves."""
    half, low = _U(31), _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << half) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo 2^61 - 1."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n."""
    have = _powers.get(base, np.ones(1, _U))
    while len(have) <= n:
        more = have[: n + 1 - len(have)] if n + 1 > _KEPT_POWERS else have
        have = np.concatenate((have, times(more, np.full(len(more), pow(base, len(have), int(_P)), _U))))
    if len(have) <= 2 * _KEPT_POWERS:
        _powers[base] = have
    return have[: n + 1]


class RangeHashes:
    """122-bit hashes of ranges of a symbol sequence: equal ranges have equal hashes wherever they lie.

    Two polynomials of the symbols, modulo a prime at two fixed bases.  Different
    ranges of up to n symbols agree in a lane for at most n of its 2^61 bases.
    """

    def __init__(self, h: np.ndarray, second: np.ndarray | None = None) -> None:
        self.lanes = []
        n, low = len(h), _U((1 << 32) - 1)
        for x, (up, down) in zip((h, mix(h, 91) if second is None else second), _BASES, strict=True):
            terms = times(reduced(x), powers(up, n)[:n])
            # Halves are summed apart, so that no sum passes 64 bits.
            high, rest = reduced(np.cumsum(terms >> _U(32), dtype=_U)), reduced(np.cumsum(terms & low, dtype=_U))
            total = reduced(times(high, np.full(n, 1 << 32, _U)) + rest)
            self.lanes.append((np.concatenate((np.zeros(1, _U), total)), powers(down, n)))

    def of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (end - begin).astype(_U)
        with np.errstate(over="ignore"):
            return tuple(mix(times(reduced(total[end] + _P - total[begin]), back[begin]) + size * _M2, i) for i, (total, back) in enumerate(self.lanes))


def scratch(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where unset on a local master (tests), a new one for this session."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandlace-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: While a phase is written: its shuffle files go once it has ended, and Arrow batches stay small, so that workers need little memory.
_PHASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs restart from there when executors are lost.

    The shuffle files of the phase go when its table is written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _PHASE}
    try:
        for k, v in _PHASE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    phase = spark.read.schema(df.schema).parquet(path)
    phase._sl_path = path
    return phase


def discard(phase: DataFrame) -> None:
    """Delete the table of a phase that ``materialize`` returned, once its successors are written."""
    context = phase.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(phase._sl_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], spread: Column, total: int, how: str = "inner", sizes: DataFrame | None = None, share: int = 1000, least: int = 1000, hint: str | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once.

    A key that over ``total / share`` of the ``total`` rows hold (and over
    ``least``) is dealt out: its rows by ``spread`` into parts of about that size, its
    table row to every part.  Such keys are fewer than ``share``, so their
    broadcast is bounded.  ``sizes`` has the keys and their numbers of rows ``n``;
    without it ``table`` has ``n`` (dropped here).  ``hint`` names the join's strategy.
    """
    keys = [key] if isinstance(key, str) else key
    if sizes is None:
        sizes, table = table, table.drop("n")
    limit = max(least, -(-total // share))
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).alias("_sl_parts")))
    parts = F.coalesce("_sl_parts", F.lit(1))
    into = F.when(F.col(keys[0]).isNull(), F.lit(1 << 16)).otherwise(parts)  # null keys match nothing and go anywhere
    dealt = rows.join(hot, keys, "left").withColumn("_sl_part", F.pmod(spread, into)).drop("_sl_parts")
    copies = table.join(hot, keys, "left").withColumn("_sl_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_sl_parts")
    return dealt.join(copies.hint(hint) if hint else copies, [*keys, "_sl_part"], how).drop("_sl_part")


def join_documents(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` (with ``did, th``) joined with ``table``, one row for each document; rows of a document that repeats very often are dealt out.

    Tables of packed ``spans`` are merged at any size: the lists grow well beyond the size of their files, which bounds no broadcast.
    """
    sizes = rows.groupBy("did", "th").agg(F.count("*").alias("n"))
    total = rows.count()
    return join_hot(rows, table, ["did", "th"], F.monotonically_increasing_id(), total, how, sizes, hint="merge" if "spans" in table.columns else None)


def identified(docs: DataFrame, id_col: str, text_col: str, passed: list | None = None) -> DataFrame:
    """``doc_id, did, th, text``: the columns that the document operators work on (a null text is empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"), *(passed or []))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one step holds at most ``limit`` bytes of ``column``, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def lean(run: Callable) -> Callable:
    """``run`` over batches; when a task ends, the worker gives the memory it no longer uses back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def pack_spans(starts: np.ndarray, width: int = 1) -> bytes:
    """Sorted start positions as merged ``(begin, end)`` pairs of covered positions, int32."""
    if len(starts) == 0:
        return b""
    starts = np.asarray(starts, np.int64)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + width)
    begin = np.concatenate(([starts[0]], starts[cut + 1]))
    end = np.concatenate((starts[cut], [starts[-1]])) + width
    return np.column_stack((begin, end)).astype("<i4").tobytes()


def pack_ranges(begin: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges in any order as merged ``(begin, end)`` pairs, int32."""
    order = np.argsort(begin, kind="stable")
    begin, end = np.asarray(begin)[order], np.maximum.accumulate(np.asarray(end)[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.column_stack((begin[at], end[np.append(at[1:], len(begin)) - 1])).astype("<i4").tobytes() if len(at) else b""


def covered(spans: list[bytes] | None, n: int, extra: int = 0) -> np.ndarray:
    """Boolean mask over ``n`` positions of the union of packed spans, each ``extra`` longer."""
    if not spans:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(pairs[:, 0], n), 1)
    np.add.at(edge, np.minimum(pairs[:, 1] + extra, n), -1)
    return np.cumsum(edge[:n]) > 0


# --- the earliest holder of each key ------------------------------------------------------------

#: ``key`` and ``twin`` are the two halves of a 128-bit hash; ``size`` is the kind of key: 0 or the length of a block.
CLAIMS = "key long, twin long, size int, did long, th long, pos int, spans binary"
SPANS = "did long, th long, block boolean, spans binary"
_LOST = ["did", "th", "block", "spans"]
#: Parts into which the span lists of one document are dealt before they are merged.
_DEAL = 16


def documents_in_order(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a step in identity order, repeated documents once."""
    did, th = ints(batch, "did"), ints(batch, "th")
    order = np.lexsort((th, did))
    new = np.ones(len(order), bool)
    new[1:] = (did[order][1:] != did[order][:-1]) | (th[order][1:] != th[order][:-1])
    return order[new]


def local_claims(keys: tuple[np.ndarray, np.ndarray], docs: np.ndarray, pos: np.ndarray, did: np.ndarray, th: np.ndarray, width: int, with_first: bool, size: np.ndarray | None = None, window: int = 1) -> pa.RecordBatch:
    """Claims of one step, pre-aggregated: one row for each distinct key, and later holders as ready spans.

    ``docs`` indexes the step's documents, which are sorted by identity, so that
    array order is occurrence order.  A key that the step holds twice needs no
    further proof: its later holders (with ``with_first`` all of them) go out as
    spans of their documents, and only the first holder competes globally.
    Spans have ``width`` positions; with ``size`` those of the windows of
    ``window`` words inside a block of that size.
    """
    key, twin = keys
    order = np.argsort(key, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = (key[order][1:] != key[order][:-1]) | (twin[order][1:] != twin[order][:-1])
    first = order[head]
    known = order[~head]
    if with_first and len(known):
        twice = np.zeros(len(order), bool)
        twice[:-1] |= head[:-1] & ~head[1:]
        known = np.concatenate((known, order[twice]))
    known.sort()
    n = len(first)
    sizes = np.zeros(n, np.int32) if size is None else size[first]
    out = [key[first], twin[first], sizes, did[docs[first]], th[docs[first]], pos[first]]
    blobs: list = [None] * n
    if len(known):
        owner = docs[known]
        at = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        for begin, end in zip(at.tolist(), [*at[1:].tolist(), len(known)], strict=True):
            part = known[begin:end]
            blobs.append(pack_spans(pos[part], width) if size is None else pack_ranges(pos[part], pos[part] + size[part] - window + 1))
        own = owner[at]
        # Ready spans only travel through: their keys deal them out.
        more = [mix(np.arange(len(own), dtype=_U) ^ key[0], 7), np.zeros(len(own), _U), np.full(len(own), 0 if size is None else 1), did[own], th[own], np.full(len(own), -1)]
        out = [np.concatenate((x.view(np.int64) if x.dtype == _U else x, y.view(np.int64) if y.dtype == _U else y)) for x, y in zip(out, more, strict=True)]
    key, twin, sizes, ids, hashes, at = (x.view(np.int64) if x.dtype == _U else x for x in out)
    columns = [pa.array(key), pa.array(twin), pa.array(sizes.astype(np.int32)), pa.array(ids), pa.array(hashes), pa.array(at.astype(np.int32)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "twin", "size", "did", "th", "pos", "spans"])


def _settle(width: int, with_first: bool, window: int) -> Callable:
    def run(batches):
        carry = None  # (key, twin, did, th, pos, size, told) of the first row of the run that the last batch ended in
        for b in batches:
            if b.num_rows == 0:
                continue
            row = [ints(b, c) for c in ("key", "twin", "did", "th", "pos", "size")]
            out: list = []  # (did, th, block, spans)
            ready = row[4] < 0
            if ready.any():
                out.append((row[2][ready], row[3][ready], row[5][ready] > 0, column(b, "spans").filter(pa.array(ready)).to_pylist()))
                row = [x[~ready] for x in row]
            if len(row[0]):
                joined = carry is not None and carry[0] == row[0][0] and carry[1] == row[1][0]
                if joined:
                    row = [np.concatenate(([v], x)) for v, x in zip(carry[:6], row, strict=True)]
                key, twin, did, th, pos, size = row
                n = len(key)
                head = np.ones(n, bool)
                head[1:] = (key[1:] != key[:-1]) | (twin[1:] != twin[:-1])
                first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
                again = np.zeros(n, bool)  # the same row from another step
                again[1:] = (did[1:] == did[:-1]) & (th[1:] == th[:-1]) & (pos[1:] == pos[:-1])
                late = ~head & ((did != did[first]) | (th != th[first]) | (pos != pos[first]))
                take = late & ~again
                told = False
                if with_first:
                    take[first[late & (size == 0)]] = True
                    if joined and carry[6]:
                        take[0] = False
                if joined:
                    told = carry[6] or bool(take[0])
                last = first[-1]
                carry = (*(x[last] for x in row), told if joined and last == 0 else bool(take[last]))
                got = np.flatnonzero(take)
                begin = pos[got].astype("<i4")
                raw = np.column_stack((begin, np.where(size[got] > 0, begin + size[got] - window + 1, begin + width))).astype("<i4").tobytes()
                out.append((did[got], th[got], size[got] > 0, [raw[i : i + 8] for i in range(0, len(raw), 8)]))
            if out:
                did, th, block = (np.concatenate([x[i] for x in out]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(block), pa.array([s for x in out for s in x[3]], pa.binary())], names=_LOST)

    return lean(run)


def _merge(batches):
    """One list of merged spans for each document and kind; rows come sorted by them."""
    at, held = None, []

    def told():
        pairs = np.frombuffer(b"".join(held), "<i4").reshape(-1, 2)
        return (*at, pack_ranges(pairs[:, 0], pairs[:, 1]))

    for b in batches:
        if b.num_rows == 0:
            continue
        out = []
        did, th, block = ints(b, "did"), ints(b, "th"), ints(b, "block")
        cut = np.flatnonzero((did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (block[1:] != block[:-1])) + 1
        spans = column(b, "spans").to_pylist()
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            now = (did[s], th[s], bool(block[s]))
            if at is not None and now != at:
                out.append(told())
                held = []
            at = now
            held += spans[s:e]
        held = [told()[3]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=_LOST)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told(), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=_LOST)


def later_holders(claims: DataFrame, width: int = 1, with_first: bool = False, window: int = 1) -> DataFrame:
    """Spans of every holder of a key but its earliest, in ``(did, th, pos)`` order: ``did, th, spans, blocks``, one row for each document.

    ``spans`` are the lists of keys of size 0 (with ``with_first`` those of all
    holders of a key that is held twice), ``blocks`` those of blocks: the starts of
    the ``window``-word windows inside them.

    Rows of one key are streamed in order and never gathered; each step of a
    map task adds one row to a key at most, so a key that a third of all
    documents hold brings as many rows as there are steps.  The lists of one
    document, many where its rows repeat, are merged as they stream, in parts first.
    """
    lost = claims.repartition(F.col("key")).sortWithinPartitions("key", "twin", "did", "th", "pos").mapInArrow(_settle(width, with_first, window), SPANS)
    dealt = lost.repartition(F.col("did"), F.col("th"), F.pmod(F.xxhash64("spans"), F.lit(_DEAL)))
    merged = dealt.sortWithinPartitions("did", "th", "block").mapInArrow(_merge, SPANS)
    pick = lambda block: F.collect_list(F.when(block, F.col("spans")))
    return merged.groupBy("did", "th").agg(pick(~F.col("block")).alias("spans"), pick(F.col("block")).alias("blocks"))  # _DEAL lists at most
