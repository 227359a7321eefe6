"""A register of distinct sequences that follows a growing folder of documents.

    python -m jobs.sequence_register INPUT OUTPUT [--config FILE]

Each run takes the Parquet files of ``INPUT`` that no earlier run has taken (a
file stream with the trigger ``availableNow`` and a checkpoint in
``OUTPUT/checkpoint``).  A sequence, the DNA letters of a text, is known by its
SHA-256.  The costly part, its periodogram, is made once, when the sequence is
first seen; copies that come later only add to its counts.

``OUTPUT/register`` is Parquet partitioned by ``batch`` and bucketed by
``sha``: one row for each sequence of a batch, with its number of records, its
smallest id, and, in the batch that brought it first, its ``profile``.  As it is
bucketed, new sequences are compared with the known ones without a shuffle of
the register.  A batch that is done again after a failure replaces its own
partition and looks at earlier ones only, so the result is the same.  ``INPUT``
is a folder to which files are added (or one file); a file that changes in place
is not read again.  Nulls: a null text is the empty sequence, null ids are counted
but never the smallest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings
from strandlace.functions.sequence import dna_view
from strandlace.operators.periodogram import PROFILE, PeriodogramConfig, periodogram_profiles

DEFAULTS = {"id": "doc_id", "window": 8, "factor": 12, "min_offset": 3, "max_offset": 12, "buckets": 16, "files_per_batch": 64}
ROW = f"sha STRING, length BIGINT, n_records BIGINT, first_id BIGINT, profile {PROFILE}, batch BIGINT"
#: Settings that the files of a register depend on.
LAYOUT = ("window", "factor", "min_offset", "max_offset", "buckets")


def sequences(docs: DataFrame, id_col: str) -> DataFrame:
    """``sha, seq, length, n_records, first_id``: the distinct sequences of some documents."""
    seq = dna_view(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), seq.alias("seq"))
    rows = rows.withColumn("sha", F.sha2(F.col("seq").cast("binary"), 256))
    return rows.groupBy("sha").agg(F.first("seq").alias("seq"), F.first(F.length("seq")).cast("long").alias("length"), F.count("*").alias("n_records"), F.min("id").alias("first_id"))


def take(batch: DataFrame, number: int, table: str, cfg: dict) -> DataFrame:
    """The register's rows of one batch of documents.

    The batch's sequences come in as many parts as the register has buckets, so
    that they meet the known ones where those lie; each part makes its new
    profiles and becomes one bucket of the batch.
    """
    scan = PeriodogramConfig(**{k: cfg[k] for k in ("window", "factor", "min_offset", "max_offset")})
    mine = sequences(batch, cfg["id"]).repartition(cfg["buckets"], "sha")
    known = batch.sparkSession.table(table).where(F.col("batch") < number).select("sha").distinct().withColumn("_known", F.lit(True))
    rows = mine.join(known, "sha", "left").withColumn("seq", F.when(F.col("_known").isNull(), F.col("seq")))
    return periodogram_profiles(rows, "seq", scan, ["sha", "length", "n_records", "first_id"]).withColumn("batch", F.lit(number).cast("long"))


def define(spark: SparkSession, out: str, buckets: int) -> str:
    """A table over the register's files under a new name; dropping it leaves the files."""
    table, folder = f"register_{uuid.uuid4().hex}", f"{out}/register".replace("\\", "\\\\").replace("'", "\\'")
    spark.createDataFrame([], ROW).write.mode("append").partitionBy("batch").parquet(f"{out}/register")  # so that the folder is there
    spark.sql(f"CREATE TABLE {table} ({ROW}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (sha) INTO {int(buckets)} BUCKETS LOCATION '{folder}'")
    spark.catalog.recoverPartitions(table)
    return table


def layout(spark: SparkSession, out: str, cfg: dict) -> None:
    """Keep what the files depend on beside them; a later run with other settings is an error."""
    mine = json.dumps({k: cfg[k] for k in LAYOUT}, sort_keys=True)
    spark.createDataFrame([], "value string").write.mode("append").text(f"{out}/layout")
    found = [r["value"] for r in spark.read.schema("value string").text(f"{out}/layout").distinct().limit(2).collect()]
    if not found:
        spark.createDataFrame([(mine,)], "value string").coalesce(1).write.mode("append").text(f"{out}/layout")
    elif found != [mine]:
        raise ValueError(f"{out} was made with {found[0]}, not {mine}; use another folder")


def run(spark: SparkSession, source: str, out: str, config: str | None = None, **given) -> dict:
    """Take the new files of ``source`` into the register in ``out``; returns what was read and written."""
    cfg = settings(spark, config, DEFAULTS) | given
    out = out.rstrip("/")
    layout(spark, out, cfg)
    table = define(spark, out, cfg["buckets"])
    told = {"source": source, "output": f"{out}/register", "batches": 0, "records": 0, "sequences": 0, "new": 0}

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession  # the stream's own copy, so its settings are not the caller's
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        take(batch, number, table, cfg).write.mode("overwrite").insertInto(table)
        got = session.table(table).where(F.col("batch") == number).agg(F.sum("n_records").alias("records"), F.count("*").alias("sequences"), F.count("profile").alias("new")).first()
        told["batches"] += 1
        for k in ("records", "sequences", "new"):
            told[k] += got[k] or 0
        log.info("batch %d: %s records, %s sequences, %s new", number, got["records"], got["sequences"], got["new"])

    try:
        schema = spark.read.parquet(source).schema
        # As a pattern, since a stream's plain path must be a folder and the table may be one file.
        path = source.rstrip("/")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
        writer = stream.select(cfg["id"], "text").writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    log.info("read and wrote %s", json.dumps(told))
    return told


def output(spark: SparkSession, out: str) -> DataFrame:
    """All sequences of the register in ``out``: ``sha, length, n_records, first_id, k, raw_sum, signal_sum, n_pairs``."""
    rows = spark.read.schema(ROW).parquet(f"{out.rstrip('/')}/register")
    once = rows.groupBy("sha").agg(F.max("length").alias("length"), F.sum("n_records").alias("n_records"), F.min("first_id").alias("first_id"), F.first("profile", ignorenulls=True).alias("profile"))
    return once.select("sha", "length", "n_records", "first_id", F.inline("profile"))


if __name__ == "__main__":
    main(run, __doc__, "sequence_register.json")
