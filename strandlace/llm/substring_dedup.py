"""Substring dedup by recompression.

A text is a string of word symbols.  Each recompression round replaces maximal
runs of one symbol and then pairs of a left and a right symbol (the side is one
bit of the symbol's hash).  Names are hashes of what they stand for, so all
tasks give equal substrings the same names without a shared dictionary, and a
boundary between blocks depends only on the blocks beside it: inside an equal
substring the blocks of both occurrences agree.

Rounds go on until no two blocks are joined.  The blocks of the higher rounds, from
``window`` words on, are claimed by their 128-bit names: a block that also starts
earlier is a long repeat as a whole, and all windows inside it are settled at once.

What is left are windows across the blocks' ends.  A boundary that survives the second round between first-round blocks of
``c - 1`` words at most depends on ``c`` words to either side (``c`` is a
quarter of the window).  Every window picks, among such boundaries in its
middle, the one with the smallest name; equal windows pick the same one.  Picks
with a name and context that occur once can't lie in a repeated window.  For
the others, the windows that no block settled are compared by 128-bit hashes.  (The
earliest occurrence of a window is never settled, so it always takes part.)

Spark work: picks and blocks are claimed by name (one narrow row for each and map
step), repeated picks return to their documents, the open windows over them are
claimed by content, and later holders return to be cut out.  Rows of a key are
streamed in order, never gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLAIMS, RangeHashes, column, covered, documents_in_order, identified, ints, join_documents, later_holders, lean, local_claims, materialize, mix, steps

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def recompress(names: np.ndarray, starts: np.ndarray, fresh: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over blocks (names, first word, starts-a-document): runs, then pairs."""
    if len(names) == 0:
        return names, starts, fresh
    head = fresh.copy()
    head[0] = True
    head[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(names))).astype(_U)
    base, starts, fresh = names[at], starts[at], fresh[at]
    named = np.where(length > 1, mix(base ^ mix(length, 3 * level), 3 * level + 1), base)
    right = (mix(base, 3 * level + 2) & _U(1)).astype(bool)
    paired = np.zeros(len(base), bool)  # with the block before
    paired[1:] = ~right[:-1] & right[1:] & ~fresh[1:]
    at = np.flatnonzero(~paired)
    second = np.zeros(len(at), bool)
    second[:-1] = np.diff(at) == 2
    if len(at) and at[-1] == len(base) - 2:
        second[-1] = True
    with np.errstate(over="ignore"):
        both = mix(named[at] * _U(0x9E3779B97F4A7C15) + named[np.minimum(at + 1, len(base) - 1)], 3 * level + 1)
    return np.where(second, both, named[at]), starts[at], fresh[at]


def rounds(h: np.ndarray, offsets: np.ndarray):
    """Names, first words and document starts of the blocks of each round, the words being the first."""
    fresh = np.zeros(len(h), bool)
    fresh[offsets[:-1][offsets[:-1] < len(h)]] = True
    now, level = (h, np.arange(len(h)), fresh), 0
    while True:
        yield now
        level += 1
        before, now = now, recompress(*now, level)
        if len(now[0]) == len(before[0]) and level > 4:  # a round that joins nothing may be followed by one that does
            return


def picks(levels: list, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one document: its first word and the picked boundary.

    ``levels`` are the first three of ``rounds``; document d has the words from
    ``offsets[d]`` to ``offsets[d + 1]``.
    """
    (h, _, _), (n1, s1, _), (_, s2, f2) = levels
    n, c = len(h), window // 4
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = np.diff(np.append(s1, n)) <= c - 1
    value = np.full(n, _NONE, _U)
    j = np.searchsorted(s1, s2)
    inner = (~f2) & (j > 0)
    j, b = j[inner], s2[inner]
    ok = small[j] & small[j - 1]
    j, b = j[ok], b[ok]
    with np.errstate(over="ignore"):
        value[b] = mix(n1[j - 1] * _U(0x9E3779B97F4A7C15) + n1[j], 77) >> _U(1)
    first = np.arange(n - window + 1)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    first = first[first + window <= owner_end[first]]
    if len(first) == 0:
        return first, first
    view = np.lib.stride_tricks.sliding_window_view(value, window - 2 * c + 1)
    lo = np.zeros(len(first), np.int64)
    for part in range(0, len(first), 1 << 18):
        lo[part : part + (1 << 18)] = view[first[part : part + (1 << 18)] + c].argmin(axis=1)
    at = first + c + lo
    return first, np.where(value[at] == _NONE, first + window // 2, at)  # no such boundary (long runs): the middle word stands in


def blocks(levels, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of all different blocks of ``window`` words or more."""
    found, before = [], np.zeros(0, np.int64)
    for _, start, _ in levels:
        size = np.diff(np.append(start, total))
        at = np.flatnonzero(size >= window)
        if len(at):
            span = start[at] * (total + 1) + size[at]
            found.append(span[~np.isin(span, before, assume_unique=True)])
            before = span
    both = np.concatenate(found) if found else before
    return both // (total + 1), both % (total + 1)


def _step(batch: pa.RecordBatch) -> tuple:
    """The step's documents in identity order, repeated rows once: did, th, symbols, offsets, row of each."""
    order = documents_in_order(batch)
    texts = column(batch, "text")
    x = xxhash.xxh64_digest
    parts, sizes = [], []
    for i in order:
        words = texts[int(i)].as_py().split()
        sizes.append(len(words))
        parts.append(b"".join(map(x, words)))
    h = np.frombuffer(b"".join(parts), "<u8").astype(_U)
    return ints(batch, "did")[order], ints(batch, "th")[order], h, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), order


def _claim_symbols(window: int):
    c = window // 4

    def run(batches):
        for b in steps(batches):
            did, th, h, offsets, _ = _step(b)
            if len(h) < window:
                continue
            levels = list(rounds(h, offsets))
            hashes = RangeHashes(h)
            _, at = picks(levels[:3], offsets, window)
            if len(at) == 0:
                continue
            at = np.unique(at)
            doc = np.searchsorted(offsets, at, side="right") - 1
            yield local_claims(hashes.of(at - c, at + c), doc, at - offsets[doc], did, th, 1, True)
            begin, size = blocks(levels[1:], len(h), window)
            if len(begin):
                order = np.lexsort((size, begin))
                begin, size = begin[order], size[order]
                doc = np.searchsorted(offsets, begin, side="right") - 1
                yield local_claims(hashes.of(begin, begin + size), doc, begin - offsets[doc], did, th, 1, False, size.astype(np.int32), window)

    return lean(run)


def _claim_windows(window: int):
    def run(batches):
        for b in steps(batches):
            did, th, h, offsets, order = _step(b)
            hashes = RangeHashes(h)
            levels = rounds(h, offsets)
            first, at = picks([next(levels) for _ in range(3)], offsets, window) if len(h) else (h, h)
            if len(at) == 0:
                continue
            marked, settled = np.zeros(len(h), bool), np.zeros(len(h), bool)
            spans, inside = column(b, "spans"), column(b, "blocks")
            for d, row in enumerate(order):
                here = slice(offsets[d], offsets[d + 1])
                size = int(offsets[d + 1] - offsets[d])
                marked[here] = covered(spans[int(row)].as_py(), size)
                settled[here] = covered(inside[int(row)].as_py(), size)
            first = first[marked[at] & ~settled[first]]
            if len(first):
                doc = np.searchsorted(offsets, first, side="right") - 1
                yield local_claims(hashes.of(first, first + window), doc, first - offsets[doc], did, th, 1, False)

    return lean(run)


def _cut(window: int):
    def run(batches):
        for b in steps(batches):
            rows = []
            for doc_id, text, spans in zip(*(column(b, c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = text.split()
                if spans:
                    gone = covered(spans, len(words), window - 1)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    rows.append((doc_id, len(words), int(gone.sum()), kept))
                else:
                    rows.append((doc_id, len(words), 0, b" ".join(words)))
            ids, n, gone, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return lean(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Cut every word covered by a ``window``-word sequence that also starts earlier.

    Earlier means: a smaller id, then a smaller text hash (rows that share an
    id), then an earlier start in the same document.  Windows are judged on the
    input.  Returns ``doc_id, n_words, n_removed, kept_sha256, kept_text``, one row for each
    input row.  A null or empty text has no words; texts shorter than the window stay
    whole; a null id comes before all others; identical rows are one document
    and lose the same words; other columns are not read, whatever their names; a
    very long text is a step of its own and is compared whole; an empty table gives no rows.
    """
    if window < 8:
        raise ValueError("window must be 8 words or more")
    rows = identified(docs, id_col, text_col)
    texts = rows.select("did", "th", "text")
    marks = materialize(later_holders(texts.mapInArrow(_claim_symbols(window), CLAIMS), 1, True, window), "repeated-symbols")
    open_windows = join_documents(texts, marks, "inner").mapInArrow(_claim_windows(window), CLAIMS)
    gone = materialize(later_holders(open_windows).select("did", "th", "spans"), "repeated-windows")
    both = gone.unionAll(marks.select("did", "th", F.col("blocks").alias("spans"))).groupBy("did", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return join_documents(rows, both).select("doc_id", "text", "spans").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op6(spark, sf_dir: str) -> DataFrame:
    """``remove_repeats`` over all documents, without the kept text."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
