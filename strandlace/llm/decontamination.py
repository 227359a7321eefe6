"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of segments, one for each map step of the training
documents: the segment's terms in order, and for each term the list of its positions.
Terms are XXH64 of words.  The index is built once and serves any number of test sets.

The test side, distinct windows of item words, is cut into blocks of about ``block_windows``
windows.  One block at a time is broadcast and asked of all segments.  In a segment each
window starts from the list of its rarest term there, shifted by the term's offset in the window, and
is intersected with the shifted lists of the other terms, rarest first; what is
left are exact phrases.  Proximity matches look in the same lists for the window's
three rarest terms near their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, covered, discard, identified, ints, join_hot, lean, materialize, pack_ranges, steps

_U = np.uint64
_WORD = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z and turns ASCII characters outside words into spaces, in UTF-8.
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _WORD else 0x20 for c in range(256))
#: Text bytes of one segment, and list entries that a search looks at together.
SEGMENT_BYTES = 2 << 20
_LOOK = 1 << 20

INDEX = "segment long, doc_id array<long>, did array<long>, th array<long>, n_words array<long>, terms binary, ends binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _terms(words: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh64_digest, words))


class Segment:
    """Positional lists of the documents of one map step; positions count on from document to document."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, n_words: np.ndarray) -> None:
        self.terms, self.ends, self.positions = terms, ends, positions
        self.offsets = np.concatenate(([0], np.cumsum(n_words))).astype(np.int64)

    @classmethod
    def build(cls, docs: list[bytes]) -> Segment:
        """The segment of documents given as packed terms."""
        h = np.frombuffer(b"".join(docs), "<u8")
        order = np.argsort(h, kind="stable")
        terms, count = np.unique(h, return_counts=True)
        return cls(terms, np.cumsum(count).astype("<i4"), order.astype("<i4"), np.array([len(d) // 8 for d in docs], np.int64))

    def lists(self, wanted: np.ndarray) -> Lists:
        """The lists of the ``wanted`` terms (sorted)."""
        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == wanted if len(self.terms) else np.zeros(len(wanted), bool)
        end = np.where(there, self.ends[at], 0).astype(np.int64) if len(self.terms) else np.zeros(len(wanted), np.int64)
        begin = np.where(there & (at > 0), self.ends[at - 1], 0).astype(np.int64) if len(self.terms) else end
        count = end - begin
        first = np.repeat(begin, count)
        within = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        return Lists(count, self.positions[first + within].astype(np.int64), self.offsets)


class Lists:
    """Positional lists of a block's terms in one segment."""

    def __init__(self, count: np.ndarray, positions: np.ndarray, offsets: np.ndarray) -> None:
        self.count, self.positions, self.offsets = count, positions, offsets
        self.begin = np.concatenate(([0], np.cumsum(count)))
        self.n = int(offsets[-1]) + 1
        #: All entries as term times n plus position: sorted, so that a list is searched by its term's part.
        self.entries = np.repeat(np.arange(len(count)), count) * self.n + positions

    def parts(self, terms: np.ndarray):
        """``who, position`` of all entries of the lists of ``terms``, a bounded number at a time; ``who`` indexes ``terms``."""
        count = self.count[terms]
        total = np.cumsum(count)
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _LOOK, side="right")))
            for low in range(0, int(count[at]) if to == at + 1 else 1, _LOOK):  # one long list goes in pieces
                n = np.minimum(count[at:to] - low, _LOOK) if to == at + 1 else count[at:to]
                who = np.repeat(np.arange(at, to), n)
                within = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low
                yield who, self.positions[self.begin[terms[who]] + within]
            at = to

    def holds(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term's list has a position from ``low`` to before ``high``."""
        return np.searchsorted(self.entries, terms * self.n + low) < np.searchsorted(self.entries, terms * self.n + np.maximum(low, high))

    def exact(self, grid: np.ndarray, size: np.ndarray):
        """``window, start`` of every exact phrase; ``grid`` has a window's terms in a row, -1 beyond its ``size``."""
        often = np.where(grid >= 0, self.count[grid], 2**62)
        live = np.flatnonzero(often.min(axis=1) > 0)
        order = np.argsort(often[live], axis=1, kind="stable")
        for who, pos in self.parts(grid[live, order[:, 0]] if len(live) else live):
            start = pos - order[who, 0]
            doc = np.searchsorted(self.offsets, pos, side="right") - 1
            ok = (start >= self.offsets[doc]) & (start + size[live[who]] <= self.offsets[doc + 1])
            who, start = who[ok], start[ok]
            for k in range(1, grid.shape[1]):
                off = order[who, k]
                term = grid[live[who], off].astype(np.int64)
                at = start + off
                ok = (term < 0) | self.holds(np.maximum(term, 0), at, at + 1)
                who, start = who[ok], start[ok]
            yield live[who], start

    def near(self, grid: np.ndarray, rare: np.ndarray, slack: int):
        """``window, document`` where the window's ``rare`` terms all lie within ``slack`` words of their places."""
        rows = np.arange(len(grid))
        terms = grid[rows[:, None], rare].astype(np.int64)
        live = np.flatnonzero(np.all((terms < 0) | (self.count[terms] > 0), axis=1))
        for who, pos in self.parts(terms[live, 0] if len(live) else live):
            doc = np.searchsorted(self.offsets, pos, side="right") - 1
            for k in range(1, rare.shape[1]):
                window = live[who]
                want = pos + rare[window, k] - rare[window, 0]
                low, high = np.maximum(want - slack, self.offsets[doc]), np.minimum(want + slack + 1, self.offsets[doc + 1])
                ok = (terms[window, k] < 0) | self.holds(np.maximum(terms[window, k], 0), low, high)
                who, pos, doc = who[ok], pos[ok], doc[ok]
            yield live[who], doc


def _index(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for b in steps(batches, limit=SEGMENT_BYTES):
        docs = [_terms(words_of(t.as_buffer().to_pybytes())) for t in column(b, "text")]
        s = Segment.build(docs)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), x)
        ids = [one(column(b, c)) for c in ("doc_id", "did", "th")]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (s.terms.astype("<u8"), s.ends, s.positions)]
        yield pa.RecordBatch.from_arrays([pa.array([number]), *ids, one(pa.array([len(d) // 8 for d in docs], pa.int64())), *blobs], names=["segment", "doc_id", "did", "th", "n_words", "terms", "ends", "positions"])
        number += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of all documents, to be searched with ``search_index``."""
    return materialize(identified(docs, id_col, text_col).mapInArrow(lean(_index), INDEX), "positional-index")


def _windows(width: int):
    def run(batches):
        for b in steps(batches):
            out: list = []
            for item, text in zip(column(b, "item").to_pylist(), column(b, "text").to_pylist(), strict=True):
                words = words_of(text)
                terms = _terms(words)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    part = terms[8 * i : 8 * (i + width)]
                    out.append((xxhash.xxh64_intdigest(part) - 2**63, part, item))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["window", "terms", "item"])

    return lean(run)


def _blocks(windows: DataFrame, width: int, block_windows: int):
    """Blocks of distinct windows, one at a time on the driver: window ids, terms, grid of term numbers, sizes, three rarest places."""
    once = materialize(windows.groupBy("window").agg(F.first("terms").alias("terms")), "distinct-windows")
    parts = -(-once.count() // block_windows)
    for part in range(parts):
        rows = once.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).toArrow()
        blobs = rows.column("terms").combine_chunks()
        size = np.array([len(x) // 8 for x in blobs.to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(blobs.to_pylist()), "<u8")
        terms, number, used = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        grid = np.full((len(size), width), -1, np.int32)
        grid[row, place] = number
        # The first three places of each window by rarity in the tests, for proximity.
        often = np.where(grid < 0, 2**62, used[grid])
        rare = np.argsort(often, axis=1, kind="stable")[:, : min(3, width)].astype(np.int8 if width < 128 else np.int32)
        yield rows.column("window").to_numpy(), terms, grid, size, rare


def _search(told, slack: int):
    def run(batches):
        window_ids, terms, grid, size, rare = told.value
        for b in batches:
            for i in range(b.num_rows):
                row = {f: column(b, f)[i] for f in ("n_words", "terms", "ends", "positions")}
                blob = {f: np.frombuffer(row[f].as_buffer(), t) for f, t in (("terms", "<u8"), ("ends", "<i4"), ("positions", "<i4"))}
                segment = Segment(blob["terms"], blob["ends"], blob["positions"], row["n_words"].values.to_numpy())
                if not len(segment.terms):
                    continue
                lists, offsets = segment.lists(terms), segment.offsets
                hits: dict[int, list] = {}
                for window, start in lists.exact(grid, size):
                    doc = np.searchsorted(offsets, start, side="right") - 1
                    order = np.lexsort((start, doc))
                    window, start, doc = window[order], start[order], doc[order]
                    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else ():
                        d = int(doc[part[0]])
                        begin = start[part] - offsets[d]
                        hits.setdefault(d, [[], [], []])[0].append(pack_ranges(begin, begin + size[window[part]]))
                        hits[d][1].append(np.unique(window[part]))
                for window, doc in lists.near(grid, rare, slack):
                    both = np.unique(np.stack((doc, window)), axis=1)
                    for part in np.split(np.arange(both.shape[1]), np.flatnonzero(np.diff(both[0])) + 1) if both.size else ():
                        hits.setdefault(int(both[0][part[0]]), [[], [], []])[2].append(both[1][part])
                if hits:
                    place = sorted(hits)
                    names = lambda k: [window_ids[np.unique(np.concatenate(hits[d][k]))].tolist() if hits[d][k] else [] for d in place]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([column(b, "segment")[i].as_py()] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array([b"".join(hits[d][0]) for d in place], pa.binary()), pa.array(names(1), pa.list_(pa.int64())), pa.array(names(2), pa.list_(pa.int64()))],
                        names=["segment", "place", "spans", "windows", "close"],
                    )

    return lean(run)


def _count_hits(batches):
    for b in batches:
        n = [int(covered(s, w).sum()) for s, w in zip(column(b, "spans").to_pylist(), ints(b, "n_words").tolist(), strict=True)]
        names = [f.name for f in b.schema if f.name != "spans"]
        yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(n, pa.int64())], names=[*names, "n_hit"])


def search_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slack: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The rows of ``find_leaks`` for the documents of ``index``."""
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary")
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text.alias("text"))
    windows = materialize(tests.mapInArrow(_windows(width), "window long, terms binary, item string"), "windows")
    schema = "segment long, place int, spans binary, windows array<long>, close array<long>"
    found = None
    for block in _blocks(windows, width, block_windows):
        told = index.sparkSession.sparkContext.broadcast(block)
        now = materialize(index.select("segment", "n_words", "terms", "ends", "positions").mapInArrow(_search(told, slack), schema), "matches")
        told.destroy()
        found = now if found is None else found.unionAll(now)
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_id", "did", "th", "n_words")).alias("place", "d")).select("segment", "place", "d.*")
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    # A window that very many documents hold is dealt out where it meets its items.
    each = found.select("segment", "place", F.explode("windows").alias("window"), F.lit(True).alias("exact")).unionAll(found.select("segment", "place", F.explode("close"), F.lit(False)))
    sizes = each.groupBy("window").agg(F.count("*").alias("n"))
    items = join_hot(each, windows.select("window", "item").distinct(), "window", F.xxhash64("segment", "place"), each.count(), sizes=sizes)
    listed = lambda exact: F.sort_array(F.collect_set(F.when(F.col("exact") == exact, F.col("item"))))
    items = items.groupBy("segment", "place").agg(listed(True).alias("items"), listed(False).alias("near_items"))
    spans = found.groupBy("segment", "place").agg(F.collect_list("spans").alias("spans"))  # one list a block
    rows = docs.join(spans, ["segment", "place"], "left").join(items, ["segment", "place"], "left")
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "did", "th", "n_words", "spans", F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    counted = rows.mapInArrow(_count_hits, "doc_id long, did long, th long, n_words long, items array<string>, near_items array<string>, n_hit long")
    n = lambda c: F.size(c).cast("long")
    return counted.select("doc_id", "did", "th", "n_words", "n_hit", n("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "items", n("near_items").alias("n_near"), "near_items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slack: int = 10, block_windows: int = 200_000) -> DataFrame:
    """One row for each document: ``doc_id, did, th, n_words, n_hit, n_items, items_sha256, items, n_near, near_items``.

    ``n_hit`` words lie in an occurrence of a test window (``width`` consecutive
    item words, or a shorter item's words); ``items`` are the items with
    occurring windows, ``near_items`` are those of proximity matches (by a window's three rarest terms), ``n_near`` their number.  Null
    and empty texts have no words; items without words have no window; items
    that share an id are one item, a null id is the empty string; terms of equal rarity
    go by their place; identical rows get identical results.  A very long text is a
    segment of its own; an empty table gives no rows; other columns are not read, whatever their names.
    """
    index = build_index(docs, id_col, text_col)
    found = materialize(search_index(index, benchmark, item_col, item_text_col, width, slack, block_windows), "leaks")
    discard(index)
    return found


def op8(spark, sf_dir: str) -> DataFrame:
    """``find_leaks`` of the whole benchmark in all documents."""
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("contaminated", F.col("n_hit") > 0).drop("did", "th", "items", "near_items")
