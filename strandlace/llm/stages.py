"""The corpus pipeline's stages: each applies one operator's decisions to the documents.

Common to all: every stage works on all rows and whole texts of its input; null
ids and texts, repeated ids and columns of any name are allowed; an empty
table gives an empty table; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, join_documents
from .decontamination import find_leaks
from .line_dedup import remove_repeated_lines
from .packing import pack
from .quality import judge
from .simhash import near_texts


def _col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _row(docs: DataFrame) -> Column:
    return F.struct(*(_col(c).alias(c) for c in docs.columns)).alias("_sl_row")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("_sl_row")[c].alias(c) for c in docs.columns]


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged; repeated rows are judged alike and all stay or go."""
    return judge(docs, keep=[_row(docs)]).where("kept").select(*_columns(docs))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows (a null text becomes empty); those that lose their last word go.

    Of documents with the same window that with the smallest id keeps it; repeated rows are one document.
    """
    cleaned = remove_repeated_lines(docs, keep=[F.struct(*(_col(c).alias(c) for c in docs.columns if c != "text")).alias("_sl_row")])
    cut = F.col("n_removed") > 0
    out = {c: F.col("kept_text") if c == "text" else F.col("_sl_row")[c] for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return cleaned.where(~cut | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(*(out[c].alias(c) for c in docs.columns))


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles.

    The one with the smallest id stays (null before all), then the smallest text hash, then the row that
    comes first by its other columns.
    """
    groups = near_texts(docs).select("root", "did", "th").distinct()
    first = groups.groupBy("root").agg(F.min(F.struct("did", "th")).alias("k")).select("k.did", "k.th")
    others = [_col(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = identified(docs, "doc_id", "text", [_row(docs), F.to_json(F.struct(*others)).alias("_sl_order")] if others else [_row(docs), F.lit("").alias("_sl_order")])
    # Repeated rows become one before the shuffle.
    once = rows.groupBy("did", "th").agg(F.min_by("_sl_row", F.coalesce("_sl_order", F.lit(""))).alias("_sl_row"))
    return once.join(first, ["did", "th"], "left_semi").select(*_columns(docs))


def leak_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; repeated rows are judged alike."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select("did", "th").distinct().withColumn("_sl_hit", F.lit(True))
    rows = identified(docs, "doc_id", "text", [_row(docs)]).select("did", "th", "_sl_row")
    return join_documents(rows, hit).where("_sl_hit IS NULL").select(*_columns(docs))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
