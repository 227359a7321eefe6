"""Product codes of vectors: small codebooks by part, nearest entries by vantage-point trees.

A vector's components become integers, and the vector is cut into equal parts.
Each part position has a codebook; a part's code is the index of its nearest
entry.  Entries of a position form a vantage-point tree.  All parts of a step
walk it together: one greedy descent gives each a first bound, then every node
is visited by the parts whose bound reaches it.  Radii are square roots rounded
away from the truth, a child is visited where its least distance equals the
bound, and only exact integer distances decide, so the result is that of a
search of all entries, ties to the lower index included.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ints, join_hot, lean, materialize, steps

KEPT = "vec_id long, label string, q binary"
_BIAS = 1 << 31
#: Components are kept within 30 bits; ``_bound`` narrows that to what squared distances can hold.
_MOST = 1 << 30
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def _bound(dim: int) -> int:
    """The largest component whose squared distances over ``dim`` components fit into 63 bits."""
    return min(_MOST, math.isqrt((2**63 - 1) // max(dim, 1)) // 2)


@dataclass(frozen=True)
class Node:
    """A vantage entry; ``near`` and ``far`` are (least, largest, child) of the distances to the entries of each side."""

    entry: int
    near: tuple | None = None
    far: tuple | None = None


def plant(entries: np.ndarray, members: list[int] | None = None) -> Node | None:
    """A vantage-point tree over the rows of ``entries``; the nearer half of the others hangs on one side."""
    members = list(range(len(entries))) if members is None else members
    if not members:
        return None
    top, *rest = members
    gap = {i: int(((entries[i] - entries[top]) ** 2).sum()) for i in rest}
    rest.sort(key=lambda i: (gap[i], i))

    def side(part: list[int]):
        return (math.sqrt(gap[part[0]]) * _DOWN, math.sqrt(gap[part[-1]]) * _UP, plant(entries, part)) if part else None

    half = (len(rest) + 1) // 2
    return Node(top, side(rest[:half]), side(rest[half:]))


def nearest(tree: Node, entries: np.ndarray, parts: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of ``parts``, ties to the lower index; ``seen`` gets the number of rows at each node."""
    n = len(parts)
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))

    def measure(node: Node, rows: np.ndarray) -> np.ndarray:
        d = ((parts[rows] - entries[node.entry]) ** 2).sum(axis=1)
        better = (d < best[rows]) | ((d == best[rows]) & (node.entry < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], node.entry
        return np.sqrt(d.astype(np.float64))

    def descend(node: Node, rows: np.ndarray) -> None:
        root = measure(node, rows)
        near = np.full(len(rows), node.far is None) if node.far is None or node.near is None else root <= (node.near[1] + node.far[0]) / 2
        for child, take in ((node.near, near), (node.far, ~near)):
            if child is not None and take.any():
                descend(child[2], rows[take])

    def search(node: Node, rows: np.ndarray) -> None:
        root = measure(node, rows)
        if seen is not None:
            seen.append(len(rows))
        low, high = root * _DOWN, root * _UP
        for child in (node.near, node.far):
            if child is not None:
                least = np.maximum(child[0] - high, low - child[1])
                take = least <= np.sqrt(best[rows].astype(np.float64)) * _UP
                if take.any():
                    search(child[2], rows[take])

    if n:
        descend(tree, np.arange(n))
        search(tree, np.arange(n))
    return at, best


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers, ``(parts, entries, width)``; a vector has ``parts * width`` components, ``scale`` for each unit."""

    entries: np.ndarray
    scale: int = 4096

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vector(self, code: str) -> np.ndarray:
        """The real vector that a code stands for."""
        return np.concatenate([self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]) / self.scale


def _quantised(scale: int):
    def run(batches):
        for b in batches:
            vectors = column(b, "vector")
            start = np.asarray(vectors.offsets).astype(np.int64)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            with np.errstate(over="ignore", invalid="ignore"):
                # Nulls among the components arrive as NaN.
                whole = np.floor(flat * scale)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            keep = np.asarray(vectors.is_valid()) & (bad[start[1:]] == bad[start[:-1]])
            if not keep.any():
                continue
            raw = (np.clip(np.nan_to_num(whole, nan=0.0), -_MOST, _MOST).astype(np.int64) + _BIAS).astype(">u4").tobytes()
            got = np.flatnonzero(keep).tolist()
            data = [raw[4 * s : 4 * e] for s, e in zip(start[got], start[np.add(got, 1)], strict=True)]
            take = pa.array(got)
            yield pa.RecordBatch.from_arrays([column(b, "vec_id").take(take), column(b, "label").take(take), pa.array(data, pa.binary())], names=["vec_id", "label", "q"])

    return lean(run)


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 4096) -> DataFrame:
    """``vec_id, label, q``: floors of ``scale`` times each component, big-endian with the sign flipped, so that bytes sort as the integers do.

    Rows whose vector is null or holds a null or non-finite component go; an empty vector stays.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull()).mapInArrow(_quantised(scale), KEPT)


def _matrix(q: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors of a step; short ones end in zeros."""
    out = np.zeros((len(q), dim), np.int64)
    for i, raw in enumerate(q.to_pylist()):
        out[i, : len(raw) // 4] = np.frombuffer(raw, ">u4").astype(np.int64) - _BIAS
    limit = _bound(dim)
    return np.clip(out, -limit, limit)


def _assigned(batches, books: np.ndarray):
    """(step, its parts, indices, squared distances) of each step."""
    parts, _, width = books.shape
    trees = [plant(books[p]) for p in range(parts)]
    for b in steps(batches, "q"):
        x = _matrix(column(b, "q"), parts * width).reshape(-1, parts, width)
        found = [nearest(trees[p], books[p], x[:, p]) for p in range(parts)]
        yield b, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray):
    """The count and componentwise sums of the parts of each entry, once a task."""
    parts, size, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for _, x, code, _ in _assigned(batches, books):
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    mine = code[:, p] == e
                    count[p, e] += mine.sum()
                    total[p, e] += x[mine, p].sum(axis=0)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return lean(run)


def fit(kept: DataFrame, parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of the rows of ``quantise``; None if there are none.

    They start as the parts of the first ``size`` rows by id (null ids last,
    ties by the integers), or of all if there are fewer.  Each round assigns
    every part and moves each used entry to the floor of its parts' mean.  A
    round is one pass without a shuffle of rows: each task sends ``size`` times
    the dimension of sums, and the driver gets one such table.
    The dimension is that of the longest vector, rounded up to a multiple of ``parts``, ``parts`` at least.
    """
    longest = kept.agg(F.max(F.octet_length("q"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // 4 // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(size).collect()
    books = _matrix(pa.array([bytes(r["q"]) for r in first]), parts * width).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = kept.select("q").mapInArrow(_sums(books), "part long, entry long, n long, total array<long>")
        added = sent.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        for r in added.where("at is not null").collect():
            books[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return Codebooks(books, scale)


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of the rows of ``quantise``."""
    entries = books.entries

    def run(batches):
        for b, _, code, distance in _assigned(batches, entries):
            text = code.astype(np.uint8).tobytes().hex()
            wide = 2 * len(entries)
            codes = [text[i : i + wide] for i in range(0, len(text), wide)]
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), column(b, "label"), pa.array(codes), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(lean(run), "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(``vec_id, label, code, error, label_error``, codebooks) of all rows with a finite vector.

    Vectors of other lengths than the longest end in zeros; components beyond
    about 2^30 in size, or where squared distances would leave 63 bits, count as
    that bound.  Null ids, repeated ids and repeated rows are coded like others;
    null labels are one label; a label with a large part of all rows is dealt
    out where its error is joined back; a label's error beyond a long counts as the largest long.
    An empty table, or one without a finite vector, gives no rows and no
    codebooks.  Other columns are not read, whatever their names.
    """
    if not (parts > 0 and 0 < size <= 256):
        raise ValueError("parts must be positive and size between 1 and 256")
    kept = materialize(quantise(vectors, id_col, vector_col, label_col, scale), "quantised")
    books = fit(kept, parts, size, rounds, scale)
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    coded = materialize(encode(kept, books).withColumn("_named", F.col("label").isNotNull()).withColumn("_label", F.coalesce("label", F.lit(""))), "coded")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    labels = coded.groupBy("_label", "_named").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"), F.count("*").alias("n"))
    labels = materialize(labels, "labels")
    joined = join_hot(coded, labels, ["_label", "_named"], F.xxhash64("vec_id", "code"), coded.count())
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def op12(spark, sf_dir: str) -> DataFrame:
    """All vectors in 8 parts by codebooks of 16 entries."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
