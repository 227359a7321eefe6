"""Survey of short periods: which repeat offsets stand out in each record of a collection.

    python -m jobs.period_survey INPUT OUTPUT [--config FILE]

Reads a table of documents (``doc_id, lang, text``; or FASTA files, setting
``format``), takes the DNA letters of each text and sums its self-comparison
along the diagonals ``min_offset`` to ``max_offset`` (null: half of each
record).  A record's threshold is its median plus ``mads`` scaled MADs,
``floor`` at least; local maxima from it on are its periods, ranked by score.

Writes ``OUTPUT/profiles``, Parquet partitioned by ``lang``: ``record, n_rows,
length, k, signal_mean, z_score, threshold, period_rank`` (null where ``k`` is no
period), and ``OUTPUT/manifest``, one JSON row with the settings and what was
read and written.  A run replaces both, so a rerun over the same input leaves
the same rows.  Nulls: a null text is an empty sequence, whose offsets score 0;
a null id is a record of its own for each sequence; an empty ``lang`` counts as
null.  Repeated rows are one record, counted in ``n_rows``.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import load, log, main, settings
from strandlace.functions.sequence import dna_view, letter_count
from strandlace.operators.periodogram import PeriodogramConfig, analytical_null, analytical_z, periodogram, signal_mean

DEFAULTS = {"format": "parquet", "id": "doc_id", "window": 8, "factor": 12, "min_offset": 3, "max_offset": 12, "white": 40, "black": 100, "mads": 3.0, "floor": 5.0}
PROFILES = "record string, n_rows long, length long, k long, signal_mean double, z_score double, threshold double, period_rank int, lang string"


def records(docs: DataFrame, id_col: str) -> DataFrame:
    """``record, lang, name, seq, n_rows``: distinct sequences of each id; rows that repeat are merged before the kernel sees them."""
    seq = dna_view(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("string").alias("record"), F.nullif(F.col("lang").cast("string"), F.lit("")).alias("lang"), seq.alias("seq")).withColumn("sid", F.md5(F.col("seq").cast("binary")))
    once = rows.groupBy("record", "lang", "sid").agg(F.first("seq").alias("seq"), F.count("*").alias("n_rows"))
    return once.withColumn("name", F.concat_ws(":", F.coalesce("record", F.lit("-")), F.coalesce("lang", F.lit("-")), "sid"))


def annotated(profile: DataFrame, mads: float, floor: float) -> DataFrame:
    """Scores with the record's ``threshold`` and the rank of each period; all windows share one partitioning, so one shuffle serves them."""
    own = Window.partitionBy("name")
    x = F.col("signal_mean")
    beside = lambda f: f("signal_mean").over(own.orderBy("k"))
    wide = profile.withColumns({"_before": beside(F.lag), "_after": beside(F.lead), "_median": F.median(x).over(own)})
    wide = wide.withColumn("_mad", F.median(F.abs(x - F.col("_median"))).over(own))
    threshold = F.when(F.col("_mad") <= 0, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.col("_median") + F.col("_mad") * (mads * 1.4826)))
    wide = wide.withColumn("threshold", threshold)
    wide = wide.withColumn("_period", F.coalesce((x > F.col("_before")) & (x > F.col("_after")) & (x >= F.col("threshold")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("name", "_period").orderBy(F.desc("signal_mean"), "k"))
    return wide.withColumn("period_rank", F.when(F.col("_period"), rank).cast("int"))


def survey(rows: DataFrame, cfg: dict) -> DataFrame:
    scan = PeriodogramConfig(**{k: cfg[k] for k in ("window", "factor", "min_offset", "max_offset", "white", "black")})
    # Letters are counted once, in columns of their own; the null model names each count dozens of times.
    counted = rows.withColumns({f"_{x}": letter_count(F.col("seq"), x) for x in "ACGT"})
    null = analytical_null(*(F.col(f"_{x}") for x in "ACGT"))
    ready = counted.withColumn("_null", null).select("name", "seq", "record", "lang", "n_rows", F.length("seq").cast("long").alias("length"), "_null.*")
    profile = periodogram(ready, "name", "seq", scan, ["record", "lang", "n_rows", "length", "mean", "variance"])
    scored = profile.withColumns({"signal_mean": signal_mean(), "z_score": analytical_z(F.col("mean"), F.col("variance"), scan.factor)})
    six = lambda c: F.round(c, 6).alias(c)
    return annotated(scored, cfg["mads"], cfg["floor"]).select("record", "n_rows", "length", "k", six("signal_mean"), six("z_score"), six("threshold"), "period_rank", "lang")


def counts(**more: Column) -> tuple[Observation, dict[str, Column]]:
    """Metrics that Spark gathers while the rows pass: their number and ``more``."""
    return Observation(), {"rows": F.count(F.lit(1)), **more}


def run(spark: SparkSession, source: str, out: str, config: str | None = None, **given) -> dict:
    """One survey of the table at ``source`` into the folder ``out``; settings by file, then by name.  Returns the manifest."""
    cfg = settings(spark, config, DEFAULTS) | given
    out = out.rstrip("/")
    if source.rstrip("/") == out:
        raise ValueError("the output folder is the input")
    docs = load(spark, source, cfg["format"])
    key = "record_id" if cfg["format"] == "fasta" else cfg["id"]
    read, read_columns = counts(characters=F.sum(F.length("text")), digest=F.sum(F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")))
    wrote, wrote_columns = counts(periods=F.count("period_rank"))
    result = observed(survey(records(observed(docs, read, read_columns), key), cfg), wrote, wrote_columns)
    # Rebalancing splits a language with most of the rows over several files and joins small ones.
    result.hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/profiles")
    told = {"settings": cfg, "input": {"path": source, **gathered(read, read_columns)}, "output": {"path": f"{out}/profiles", **gathered(wrote, wrote_columns)}}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    log.info("read %s", json.dumps(told["input"]))
    log.info("wrote %s", json.dumps(told["output"]))
    return told


def observed(rows: DataFrame, metrics: Observation, columns: dict[str, Column]) -> DataFrame:
    return rows.observe(metrics, *(c.alias(k) for k, c in columns.items()))


def gathered(metrics: Observation, columns: dict[str, Column]) -> dict:
    """The metrics as integers; zeros where Spark found a stage empty and left out all that stood on it."""
    try:
        found = metrics.get
    except Py4JJavaError:
        found = {}
    return {k: int(found.get(k) or 0) for k in columns}


def output(spark: SparkSession, out: str) -> DataFrame:
    """The profiles that a run left in ``out``."""
    return spark.read.schema(PROFILES).parquet(f"{out.rstrip('/')}/profiles")


if __name__ == "__main__":
    main(run, __doc__, "period_survey.json")
