"""Best-fit packing by a length histogram.

Documents become token pieces; the histogram of piece lengths, at most
``capacity`` rows, is packed best-fit decreasing by counts.  The plan says for
each length which ranks go to which sequences and offsets; a piece takes the
slot of its rank within its length.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ints, lean, materialize, steps
from .ranks import gapless

_RANK_BITS = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters from here on take the tokenizer's whole way.
LATIN_END = "\u0250"
#: ASCII symbols; one or more at a word's end after a letter are a piece of their own.
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others count on from U+0100."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()


class WordIds(dict):
    """Ids of space-free words as little-endian uint32 bytes, for a tokenizer that never merges across white space.

    At most ``limit`` words are kept, none over 64 bytes.  A word of Latin
    letters is one piece to the pre-tokenizer, so its normal form goes to the
    tokenizer's merges directly; any other word takes the whole way.
    """

    def __init__(self, path: str, limit: int = 1 << 20) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merges = self.tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, letters: str) -> bytes:
        found = self.merges(letters)
        return pack_ids(f"<{len(found)}I", *[t.id for t in found])

    def __missing__(self, word: bytes) -> bytes:
        # A lower-case ASCII word, or letters before punctuation, have the same ids by themselves.
        if word.isascii() and word.isalpha():
            low = word.lower()
            ids = self.merged(low.decode()) if low == word else self[low]
        elif (stem := word.rstrip(PUNCTUATION)) != word and (last := stem.decode("utf-8", "replace")[-1:]).lower().isalpha() and last < LATIN_END:
            ids = self[stem] + self[word[len(stem) :]]
        elif word.isascii() and (low := word.lower()) != word:
            ids = self[low]
        else:
            text = word.decode("utf-8", "replace")
            low = unicodedata.normalize("NFC", text).lower()
            ids = self.merged(low.encode().decode("latin-1").translate(BYTE_CHARS)) if low.isalpha() and max(low) < LATIN_END else self.encode(text)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        if b"<|" in text:  # may hold a special token's string, which matches before words are cut
            return self.encode(text.decode("utf-8", "replace"))
        # Small ASCII letters stand for large ones, so fewer words are kept; before a combining mark (U+0300 to U+037F) they may compose where large ones don't.
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        ids = _loaded[path]
        for b in steps(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist(), strict=True):
                buf = ids.text(text) + end
                for i, at in enumerate(range(0, len(buf), 4 * capacity)):
                    part = buf[at : at + 4 * capacity]
                    doc.append(doc_id)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return lean(run)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts.

    Returns rows (length, first rank, ranks, first sequence, pieces in each
    sequence, first offset) sorted by length and rank, and the number of
    sequences.  Sequences of the same free space are kept as ranges, so the
    work follows the number of lengths, not of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, sequences)
    spaces: list[int] = []
    rows, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                n = -(-left // (capacity // length))
                put(capacity, sequences, n)
                sequences += n
                at = bisect_left(spaces, length)
            space = spaces[at]
            first, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            each = space // length
            used = min(n, left // each)
            if not used:
                each, used = left, 1
            rows.append((length, rank, used * each, first, each, capacity - space))
            put(space - each * length, first, used)
            put(space, first + used, n - used)
            rank += used * each
            left -= used * each
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def _place(plan: np.ndarray):
    key = (plan[:, 0] << _RANK_BITS) | plan[:, 1]

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            length, rank = ints(b, "length"), ints(b, "rank")
            row = plan[np.searchsorted(key, (length << _RANK_BITS) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return lean(run)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, rows_per_bucket: int = 200_000) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; only documents of more than
    ``capacity`` tokens are cut.  A null or empty text is ``end_id`` alone; null
    ids and repeated rows are packed like others, and a row that repeats very often is
    dealt out by a stored random column; a very long text is a step of its own; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES).withColumn("_sl_deal", F.floor(F.rand() * (1 << 16))), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_best_fit(counts, capacity)
    buckets = min(1 << 16, max(64, -(-sum(counts.values()) // rows_per_bucket)))
    ranked = gapless(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.col("_sl_deal"), buckets, "rank")
    return ranked.mapInArrow(_place(plan), f"{PIECES}, sequence_id long, offset long")


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
