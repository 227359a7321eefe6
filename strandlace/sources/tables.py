"""Tab-separated interchange tables: periodograms, spectra, peaks, external profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns that tell the two input tables apart.
PERIODOGRAM = ("record_id", "k", "signal_mean", "z_score")
SPECTRUM = ("record_id", "bin", "period_residues", "amplitude", "peak_rank")


#: Different headers among the files of one table.
MOST_HEADERS = 100


def read_tsv(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """TSV files with ``#`` comments and a header each, all columns as strings; rows with another number of fields than their file's header are dropped.

    The first line of a file that is no comment is its header, whatever the order
    of its columns; the result has the columns of all files, with nulls where a
    file lacks one, and the file's path in the column ``file`` if that is named.  Which rows count doesn't depend on the columns that are read.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = raw.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("value", F.regexp_replace("value", "\r$", ""))
    # In a file's first block Spark numbers lines as they come, so the smallest number is the header's.
    numbered = lines.withColumn("_i", F.monotonically_increasing_id())
    heads = numbered.groupBy("_file").agg(F.min(F.struct("_block", "_i", "value"))["value"].alias("_head"))
    kinds = [r["_head"] for r in heads.select("_head").distinct().limit(MOST_HEADERS + 1).collect()]
    if not kinds:
        raise ValueError(f"{path}: no header")
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"{path}: over {MOST_HEADERS} different headers; these are no tables of one kind")
    if len(kinds) == 1:
        rows = lines.withColumn("_head", F.lit(kinds[0]))
    else:
        rows = lines.join(heads, "_file")
    fields, own = F.split("value", "\t", -1), F.split("_head", "\t", -1)
    rows = rows.where(F.col("value") != F.col("_head")).where(F.size(fields) == F.size(own)).select(fields.alias("f"), own.alias("h"), "_file")
    names = list(dict.fromkeys(n for k in sorted(kinds) for n in k.split("\t")))
    # Each known header has its places; rows of other files have null there.
    at = lambda n: F.coalesce(*(F.when(F.array_join("h", "\t") == k, F.col("f")[k.split("\t").index(n)]) for k in kinds if n in k.split("\t")))
    return rows.select(*((F.col("f")[kinds[0].split("\t").index(n)] if len(kinds) == 1 else at(n)).alias(n) for n in names), *([F.col("_file").alias(file)] if file else []))


def sniff(columns: list[str]) -> str:
    have = set(columns)
    if have.issuperset(PERIODOGRAM):
        return "periodogram"
    if have.issuperset(SPECTRUM):
        return "spectrum"
    raise ValueError(f"neither a periodogram nor a spectrum: {columns}")


def check_dense(df: DataFrame, key: str, k: str) -> DataFrame:
    """The rows, with an error raised where a record's ``k`` isn't consecutive."""
    before = F.lag(k).over(Window.partitionBy(key).orderBy(k))
    return df.withColumn("_ok", F.assert_true(before.isNull() | (F.col(k) == before + 1), F.concat(F.lit("gap before "), F.col(k).cast("string")))).where(F.col("_ok").isNull()).drop("_ok")


def fixed(c: str, digits: int):
    """Fixed-point text of the number's exact value, as ``printf`` writes it; exact ties go to the even digit, null stays null.

    Rounding functions and ``format_string`` round the shortest decimal digits, for which 0.8390625 is a tie; its double lies above one.
    """
    text = F.call_function("format_number", F.col(c), F.lit("0." + "0" * digits))
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.col(c).cast("string")).otherwise(text)


def periodogram_fields(df: DataFrame, *keep: str) -> DataFrame:
    """``record_id, k, raw_sum, signal_sum, signal_mean, z_score`` as the table's strings."""
    z = F.when(F.col("z_score").isNull() | F.isnan("z_score"), "NaN").otherwise(fixed("z_score", 4))
    return df.select(F.col("record_id").cast("string"), *(F.col(c).cast("string") for c in ("k", "raw_sum", "signal_sum")), fixed("signal_mean", 6).alias("signal_mean"), z.alias("z_score"), *keep)


def spectrum_fields(df: DataFrame, *keep: str) -> DataFrame:
    period = F.when(F.col("period") == float("inf"), "inf").otherwise(fixed("period", 4))
    return df.select(F.col("record_id").cast("string"), F.col("bin").cast("string"), fixed("frequency", 6).alias("frequency"), period.alias("period_residues"), fixed("amplitude", 4).alias("amplitude"), F.coalesce(F.col("peak_rank").cast("string"), F.lit("")).alias("peak_rank"), *keep)


def peak_fields(df: DataFrame, *keep: str) -> DataFrame:
    bp = lambda c: F.when(F.abs(F.col(c) - F.round(c)) < 1e-9, F.round(c).cast("long").cast("string")).otherwise(fixed(c, 2))
    own = F.col("kind") == "fundamental"
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.select(F.col("record_id").cast("string"), bp("period").alias("period_bp"), fixed("score", 4).alias("score"), "kind", F.coalesce(bp("parent"), F.lit("")).alias("parent"), text(F.col("harmonic_n")).alias("harmonic_n"), text(F.col("divisor_n")).alias("divisor_n"), F.when(own, text(F.col("n_harmonics"))).otherwise("").alias("n_harmonics"), F.when(own, F.array_join(F.col("harmonics").cast("array<string>"), ",")).otherwise("").alias("harmonics"), *keep)


def display_order(peaks: DataFrame, key: str, top: int | None = None, harmonics: bool = False) -> DataFrame:
    """Fundamentals by score, each followed by its sub-repeats, harmonics last if shown; ``row`` from 1, cut at ``top`` for each record."""
    lead = peaks.where("kind = 'fundamental'").withColumn("_f", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "period"))).select(key, F.col("period").alias("_own"), "_f")
    own = F.when(F.col("kind") == "fundamental", F.col("period")).otherwise(F.col("parent"))
    rows = (peaks if harmonics else peaks.where("kind <> 'harmonic'")).withColumn("_own", own).join(lead, [key, "_own"], "left")
    rank = F.when(F.col("kind") == "harmonic", 1).otherwise(0)
    order = Window.partitionBy(key).orderBy(rank, F.when(rank == 0, F.col("_f")).asc_nulls_last(), F.when(F.col("kind") == "fundamental", 0).otherwise(1), F.desc("score"), "period")
    out = rows.withColumn("row", F.row_number().over(order)).drop("_own", "_f")
    return out if top is None else out.where(F.col("row") <= top)


def write_tsv(df: DataFrame, path: str, comments: list[str] | None = None, lead: str | None = None, mode: str = "error") -> None:
    """Tab-separated text files, each with the ``#`` comments and the header before its rows.

    Where the column ``lead`` isn't null, it stands as a comment line before its row; it is no field.
    """
    names = [c for c in df.columns if c != lead]
    head = "\n".join([*(f"# {c}" for c in comments or []), "\t".join(names)])
    row = F.array_join(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names)), "\t")
    if lead:
        row = F.concat(F.coalesce(F.concat(F.lit("# "), F.col(lead), F.lit("\n")), F.lit("")), row)
    numbered = df.select(row.alias("value"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    # The first row of a partition brings the head along.
    first = F.col("_i") == F.shiftleft(F.col("_p").cast("long"), 33)
    numbered.select(F.when(first, F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode(mode).text(path)


def densify_profile(profile: DataFrame, key: str, min_offset: int, subtract: bool = True) -> DataFrame:
    """External profiles (``d, H, bg``) as periodogram rows: background taken off, absent offsets 0."""
    value = F.greatest(F.lit(0.0), F.col("H") - F.col("bg")) if subtract else F.col("H")
    rows = profile.where(F.col("d") >= min_offset).select(key, F.col("d").cast("long").alias("k"), value.alias("signal_mean"))
    grid = profile.groupBy(key).agg(F.max("d").cast("long").alias("_top")).where(F.col("_top") >= min_offset).select(key, F.explode(F.sequence(F.lit(min_offset).cast("long"), F.col("_top"))).alias("k"))
    return grid.join(rows, [key, "k"], "left").select(key, "k", F.coalesce("signal_mean", F.lit(0.0)).alias("signal_mean"), F.lit(float("nan")).alias("z_score"))


def read_profiles(spark: SparkSession, path: str, suffix: str = ".tsv") -> DataFrame:
    """External profile files, one for each record: ``record_id`` (the file's name without ``suffix``), ``d, H, bg``; any other set of columns is an error."""
    rows = read_tsv(spark, path, "_path")
    if sorted(rows.columns) != ["H", "_path", "bg", "d"]:
        raise ValueError(f"{path}: profiles have the columns d, H and bg, not {rows.columns[:-1]}")
    name = F.url_decode(F.substring_index("_path", "/", -1))
    return rows.select(F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name).alias("record_id"), F.col("d").cast("long").alias("d"), F.col("H").cast("double").alias("H"), F.col("bg").cast("double").alias("bg"))
