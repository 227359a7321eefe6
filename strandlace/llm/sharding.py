"""Rendezvous hashing of record keys over weighted shards.

Each shard scores a key with ``-weight / ln(u)``, u in (0, 1) from the hash of
key and shard; the highest score wins.  A key's scores for the old shards do
not change when a shard is added, so rows move into the new shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ranks import gapless


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard (a key of ``weights``) of a record key; equal scores go to the larger shard number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: int, weight: float) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)  # 53 bits
        return F.struct((F.lit(-float(weight)) / F.log((h + F.lit(0.5)) / F.lit(float(1 << 53)))).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*(score(s, w) for s, w in weights.items())))["shard"]


def assign_shards(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for each row.

    ``slot`` counts from 0 in each shard without gaps.  ``grown_shard`` is the
    shard under the weights ``grown`` (null without).  A null text has size 1
    and the CRC of the empty text; a null id is a key of its own; repeated rows
    share a shard and have slots of their own, also where one key holds a large part of
    all rows: buckets follow a stored random column.  Only narrow columns are
    shuffled.  A very long text is measured whole; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shard = rendezvous(key, weights)
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard.cast("int").alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.floor(F.rand() * (1 << 16)).alias("_sl_deal"),
    ), "sharded")
    buckets = min(1 << 16, max(256, -(-rows.count() // (rows_per_bucket * len(weights)))))
    return gapless(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("_sl_deal"), buckets, "slot").drop("_sl_deal")


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents over 8 equal shards by the law ``key``."""
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
