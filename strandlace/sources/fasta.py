"""FASTA files as record tables."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "record_idx long, record_id string, description string, sequence string"
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))


class FastaError(ValueError):
    """A sequence before any header, or a header without residues."""


def parse_fasta(data: bytes, path: str = "") -> list[tuple[int, str, str | None, str]]:
    """Records of FASTA bytes; gzip is known by its magic number or the ``.gz`` suffix.  Empty text has no records."""
    if data[:2] == b"\x1f\x8b" or path.endswith(".gz"):
        data = gzip.decompress(data)
    text = data.decode("utf-8", "replace")
    lead, *parts = ("\n" + text.replace("\r\n", "\n")).split("\n>")
    if lead.strip():
        raise FastaError("sequence before the first header")
    out = []
    for i, part in enumerate(parts):
        head, _, body = part.partition("\n")
        name, *more = head.strip().split(None, 1) or [""]
        sequence = "".join(body.split()).encode("utf-8").translate(_UPPER).decode("utf-8", "replace")
        if not sequence:
            raise FastaError(f"record {i} ({name}) has no residues")
        out.append((i, name, more[0].strip() if more else None, sequence))
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``path, record_idx, record_id, description, sequence`` of all files under ``path``; a file is one task's work."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse_fasta(content, p)
                if rows:
                    idx, name, more, seq = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), pa.array(idx, pa.int64()), pa.array(name), pa.array(more, pa.string()), pa.array(seq)], names=["path", "record_idx", "record_id", "description", "sequence"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {RECORD}")


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, record_id, description, sequence`` of all files under ``path``, plain or ending in ``.gz``.

    Spark's text reader splits plain files between records wherever the bytes allow, so a
    task holds one record at a time, whatever the size of a file.  Files begin with a header; a record without residues is an error.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    # Only a file's first record still has its mark.
    text = rows.select("path", F.regexp_replace("value", "^>", "").alias("_t"), F.regexp_extract("value", r"^>?[\t ]*([^\r\n]*)", 1).alias("_h"))
    body = F.upper(F.regexp_replace(F.substr("_t", F.length(F.substring_index("_t", "\n", 1)) + 1, F.length("_t")), r"\s", ""))
    out = text.select("path", F.regexp_extract("_h", r"^(\S*)", 1).alias("record_id"), F.nullif(F.trim(F.regexp_extract("_h", r"^\S*\s?(.*)$", 1)), F.lit("")).alias("description"), body.alias("sequence"))
    bare = F.assert_true(F.col("sequence") != "", F.concat(F.lit("a record without residues: "), "record_id"))
    return out.where(bare.isNull())


def split_records(text: Column) -> Column:
    """Array of record structs of a FASTA text column, by SQL functions only."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda p: F.length(F.trim(p)) > 0)
    head = lambda p: F.trim(F.substring_index(p, "\n", 1))
    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.cast("long").alias("record_idx"),
            F.regexp_extract(head(p), r"^(\S*)", 1).alias("record_id"),
            F.nullif(F.trim(F.regexp_extract(head(p), r"^\S*\s?(.*)$", 1)), F.lit("")).alias("description"),
            F.upper(F.regexp_replace(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p)), r"\s", "")).alias("sequence"),
        ),
    )


def record_spans(records: DataFrame, group: list[str], order: str, length: Column) -> DataFrame:
    """Half-open ``start, stop`` of each record in its group's concatenation."""
    stop = F.sum(length).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("stop", stop.cast("long")).withColumn("start", (F.col("stop") - length).cast("long"))


def fasta_text(record_id: Column, description: Column, sequence: Column, width: int = 60) -> Column:
    head = F.concat(F.lit(">"), record_id, F.coalesce(F.concat(F.lit(" "), description), F.lit("")))
    return F.concat(head, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"), F.lit("\n"))
