"""What the jobs share: settings, logging, records of a text table, the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overridden by the JSON file at ``path`` (read by Spark); an unknown name is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The table at ``path``; FASTA records count as documents named by their record."""
    if kind == "fasta":
        from strandlace.sources.fasta_chunks import read_fasta_chunks, whole_records

        return whole_records(read_fasta_chunks(spark, path)).select("record_id", F.lit(None).cast("string").alias("lang"), F.col("sequence").alias("text"))
    return spark.read.format(kind).load(path)


def main(run: Callable, about: str, config: str) -> None:
    """Parse the arguments, start a session, run, stop it."""
    root = Path(__file__).resolve().parent.parent
    sys.path[:0] = [str(root)]
    p = argparse.ArgumentParser(description=about)
    p.add_argument("input", help="path of the table of documents")
    p.add_argument("output", help="folder that the job owns")
    p.add_argument("--config", default=f"file://{root}/jobs/{config}", help="JSON settings")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from strandlace.session import ship

    spark = ship(SparkSession.builder.appName(run.__module__).getOrCreate())
    try:
        run(spark, a.input, a.output, a.config)
    finally:
        spark.stop()
