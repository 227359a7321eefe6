"""Line dedup with overlapping three-line windows.

Every run of three consecutive lines is hashed; a window whose lines also occur
earlier (in an earlier document or above in the same one) is a repeat, and the
positions that repeats cover are merged and removed.  Windows compare by 128-bit
hashes of their lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import CLAIMS, RangeHashes, column, covered, documents_in_order, identified, ints, join_documents, later_holders, lean, local_claims, materialize, steps


def _claim_lines(window: int):
    def run(batches):
        x = xxhash.xxh3_128_digest
        for b in steps(batches):
            order = documents_in_order(b)
            texts = column(b, "text")
            keys, twins, docs, pos = [], [], [], []
            for d, row in enumerate(order):
                lines = texts[int(row)].as_py().split(b"\n")
                if len(lines) < window:
                    continue
                h = np.frombuffer(b"".join(map(x, lines)), "<u8").reshape(-1, 2)
                worded = np.fromiter((bool(s.strip()) for s in lines), bool, len(lines))
                at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(worded, window).any(axis=1))
                key, twin = RangeHashes(h[:, 0], h[:, 1]).of(at, at + window)
                keys.append(key)
                twins.append(twin)
                docs.append(np.full(len(at), d))
                pos.append(at)
            if keys and sum(map(len, keys)):
                yield local_claims((np.concatenate(keys), np.concatenate(twins)), np.concatenate(docs), np.concatenate(pos), ints(b, "did")[order], ints(b, "th")[order], window, False)

    return lean(run)


def _drop_lines(batches):
    for b in steps(batches):
        rows = []
        for text, spans in zip(column(b, "text").to_pylist(), column(b, "spans").to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = covered(spans, len(lines))
            rows.append((len(lines), int(gone.sum()), text if not spans else b"\n".join([s for s, g in zip(lines, gone.tolist(), strict=True) if not g])))
        n, k, kept = zip(*rows, strict=True)
        rest = [b.column(i) for i, f in enumerate(b.schema) if f.name not in ("text", "spans")]
        names = [f.name for f in b.schema if f.name not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in kept], pa.string())], names=[*names, "n_lines", "n_removed", "kept_text"])


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, keep: list[Column] | None = None) -> DataFrame:
    """Remove the lines of every ``window``-line window that also occurs earlier.

    Returns ``doc_id, n_lines, n_removed, kept_text``, one row for each input
    row; ``keep`` columns are passed on.
    Earlier means a smaller id (null before all), then a smaller text hash, then
    a smaller line number.  Windows without a word in any line and documents of
    fewer lines than the window stay whole; identical rows are one document and
    lose the same lines; a null or empty text is one empty line.  A very long
    text is a step of its own and stays whole; an empty table gives no rows;
    columns not in ``keep`` are not read, whatever their names.
    """
    rows = identified(docs, id_col, text_col, keep)
    gone = materialize(later_holders(rows.select("did", "th", "text").mapInArrow(_claim_lines(window), CLAIMS), window).drop("blocks"), "repeated-lines")
    joined = join_documents(rows, gone).drop("did", "th")
    schema = StructType([f for f in joined.schema if f.name not in ("text", "spans")])
    return joined.mapInArrow(_drop_lines, schema.add("n_lines", LongType()).add("n_removed", LongType()).add("kept_text", StringType()))


def op3(spark, sf_dir: str) -> DataFrame:
    """``remove_repeated_lines`` over all documents."""
    return remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))
