"""Corpus preparation: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlace.llm.common import discard, materialize
from strandlace.llm.stages import leak_stage, line_stage, near_stage, packing_stage, quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", leak_stage),
    ("best_fit_packing", packing_stage),
]

#: Groups of near copies are connected components, and tokens come from a tokenizer: SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs
