"""FASTA files of any size as bounded chunks of their records.

Files are read by Spark's text reader, which splits them at line ends wherever
the bytes allow; no task ever holds a file or a record.  A block (one split of
one file) knows what lies inside it: how many records start there, and how many
letters stand before the first and the last of their headers.  Running sums of
these few numbers over a file's blocks tell each block which record was
open where it begins and how many of its letters came before; so every chunk gets its
record's number and its place in the record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .fasta import _UPPER, FastaError

#: Letters of one chunk at most.
CHUNK = 1 << 20
#: Tasks of one pass at most, or four for each core: blocks beyond that are dealt out over them.
MOST_TASKS = 256
_BLANK = bytes([*range(9, 14), *range(28, 33)])
_PIECES = "path string, block long, local long, at long, head boolean, record_id string, description string, letters string"
_FACTS = "path string, block long, heads long, letters long, before_first long, before_last long"


def _letters(lines: pa.Array) -> bytes:
    """The residues of consecutive sequence lines, upper case, without blanks."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    raw = bytes(memoryview(lines.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    if raw.isascii():
        return raw.translate(_UPPER, _BLANK)
    # A character never spans lines, so each is decoded alone.
    return "".join("".join(x.decode("utf-8", "replace").split()) for x in lines.to_pylist()).encode().translate(_UPPER)


def _runs(batches):
    """(path, block, header or None, letters) of the runs of lines of each block in order; None continues what was open."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lines, path, block = b.column(0), b.column(1), np.asarray(b.column(2))
        paths = path.dictionary_encode()
        code = np.asarray(paths.indices)
        head = np.asarray(pc.equal(pc.binary_slice(lines, 0, 1), b">"))
        new = np.ones(len(head), bool)
        new[1:] = (block[1:] != block[:-1]) | (code[1:] != code[:-1])
        cut = np.flatnonzero(new | head | np.append(False, head[:-1]))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(head)], strict=True):
            where = paths.dictionary[code[s]].as_py(), int(block[s])
            if head[s]:
                yield *where, lines[s].as_py()[1:].decode("utf-8", "replace"), b""
            else:
                yield *where, None, _letters(lines.slice(s, e - s))


def _count(letters: bytes) -> int:
    return len(letters) if letters.isascii() else len(letters.decode())


def _facts(batches):
    """What each block holds; one row for each."""
    now = None

    def row():
        heads, total, first, last = counts
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, heads, total, total if first is None else first, last)], names=[f.split()[0] for f in _FACTS.split(", ")])

    for path, block, header, letters in _runs(batches):
        if (path, block) != now:
            if now is not None:
                yield row()
            now, counts = (path, block), [0, 0, None, 0]
        if header is None:
            counts[1] += _count(letters)
        else:
            if counts[0] and counts[1] == counts[3]:
                raise FastaError(f"a record without residues: {path}")
            counts = [counts[0] + 1, counts[1], counts[1] if counts[2] is None else counts[2], counts[1]]
    if now is not None:
        yield row()


def _pieces(chunk: int):
    names = [f.split()[0] for f in _PIECES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        """``local`` is 0 for what continues a record of earlier blocks, else the record's number in its block; ``at`` counts letters from there."""
        now, local, at, held, size, out = None, 0, 0, [], 0, []

        def close():
            nonlocal held, size, at
            text = b"".join(held).decode()
            for i in range(0, len(text), chunk):
                part = text[i : i + chunk]
                out.append((*now, local, at, False, None, None, part))
                at += len(part)
            held, size = [], 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        for path, block, header, letters in _runs(batches):
            if (path, block) != now:
                if held:
                    close()
                now, local, at = (path, block), 0, 0
            if header is None:
                held.append(letters)
                size += len(letters)
                if size >= chunk:
                    close()
            else:
                if held:
                    close()
                local, at = local + 1, 0
                name, *more = header.strip().split(None, 1) or [""]
                out.append((*now, local, 0, True, name, more[0].strip() if more else None, ""))
            if len(out) >= 64:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    # Small blocks share tasks; a task streams its blocks one after the other.
    raw = raw.coalesce(max(MOST_TASKS, 4 * spark.sparkContext.defaultParallelism))
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _places(facts: DataFrame) -> DataFrame:
    """For each block: the number of records before it, and the letters that the record open at its start had before."""
    whole = Window.partitionBy("path").orderBy("block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(1, Window.unboundedFollowing)
    to = F.coalesce(F.sum("letters").over(before), F.lit(0))
    marked = facts.withColumn("_to", to)
    last_head = F.max(F.when(F.col("heads") > 0, F.col("_to") + F.col("before_last"))).over(before)
    next_head = F.min(F.when(F.col("heads") > 0, F.col("_to") + F.col("before_first"))).over(after)
    end = F.coalesce(next_head, F.sum("letters").over(Window.partitionBy("path")))
    told = marked.withColumns({"records_before": F.coalesce(F.sum("heads").over(before), F.lit(0)), "open_letters": F.col("_to") - last_head, "_tail": end - F.col("_to") - F.col("before_last")})
    lead = F.assert_true((F.col("records_before") > 0) | (F.col("before_first") == 0), F.concat(F.lit("sequence before the first header: "), "path"))
    bare = F.assert_true((F.col("heads") == 0) | (F.col("_tail") > 0), F.concat(F.lit("a record without residues: "), "path"))
    return told.where(lead.isNull() & bare.isNull()).select("path", "block", "records_before", "open_letters")


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``path, record_idx, record_id, description, start, letters``: the records of all files under ``path`` as chunks of at most ``chunk`` letters.

    ``record_id`` and ``description`` stand in the row of a record's first
    chunk, the others have nulls; ``start`` is the place of a chunk's first
    letter.  Letters are upper case, without blanks.  Plain files are split
    (``spark.sql.files.maxPartitionBytes``); a file ending in ``.gz`` is one task's stream.
    A first pass counts headers and letters block by block, into a small
    table in the shared folder; the rows then join with that table, which Spark
    broadcasts as long as its files are below its threshold.  A line is held
    whole, so a record should not stand on one line of gigabytes.  Sequence
    before the first header, or a record without residues, is an error.
    """
    places = scratch(spark)
    _places(_lines(spark, path).mapInArrow(_facts, _FACTS)).write.parquet(places)
    known = spark.read.parquet(places)
    pieces = _lines(spark, path).mapInArrow(_pieces(chunk), _PIECES)
    rows = pieces.join(known, ["path", "block"])
    start = F.when(F.col("local") == 0, F.col("open_letters") + F.col("at")).otherwise(F.col("at"))
    return rows.select("path", (F.col("records_before") + F.col("local") - 1).alias("record_idx"), "record_id", "description", start.alias("start"), "letters", F.col("head").alias("is_header")).where(F.col("is_header") | (F.col("letters") != "")).drop("is_header")


def whole_records(chunks: DataFrame, most: int = 1 << 28) -> DataFrame:
    """``path, record_idx, record_id, description, sequence`` of records of at most ``most`` letters; a longer one is an error, not a row."""
    size = chunks.groupBy("path", "record_idx").agg(F.sum(F.length("letters")).alias("_n"), F.max("record_id").alias("record_id"), F.max("description").alias("description"), F.sort_array(F.collect_list(F.struct("start", "letters"))).alias("_c"))
    ok = F.assert_true(F.col("_n") <= most, F.concat(F.lit("a record of more letters than one row may hold: "), F.col("record_id")))
    return size.withColumn("_ok", ok).where(F.col("_ok").isNull()).select("path", "record_idx", "record_id", "description", F.array_join(F.transform("_c", lambda c: c["letters"]), "").alias("sequence"))
