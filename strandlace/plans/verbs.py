"""The three runs from files to files: periodograms of a FASTA collection, peaks of a table, plots of two collections.

Each reads with the splittable readers, writes folders of text or Parquet under
one output folder, and leaves a parameter file with the resolved settings and what
was read and written.  A run replaces its output folder's parts.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import auto_zoom, gcd_of, image_dimension, snap_zoom
from ..functions.sequence import detect_alphabet, letter_count, mode_for, zoom_period_hints
from ..matrices import blosum62
from ..operators.kernel import Scoring
from ..operators.peaks import PeaksConfig, find_bin_peaks, find_peaks
from ..operators.periodogram import PeriodogramConfig, analytical_null, analytical_z, periodogram, signal_mean, z_mode
from ..operators.shuffles import shuffle_null
from ..operators.spectrum import rank_peaks, spectrum
from ..sources.fasta import record_spans
from ..sources.fasta_chunks import read_fasta_chunks, whole_records
from ..sources.images import image_files, params_toml, png, svg
from ..sources.tables import check_dense, display_order, peak_fields, periodogram_fields, read_tsv, sniff, spectrum_fields, write_tsv
from .axes import axis_marks, mark_elements
from .dotplot import PlotConfig, PlotError, dotplot

#: Image bytes of a plot at most, unless said otherwise.
MEMORY = 512 << 20


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """The records of FASTA files with ``rec``, a key whose order is that of their first appearance, and their letters' share."""
    rows = whole_records(read_fasta_chunks(spark, path)).withColumn("rec", F.concat_ws(":", "path", F.lpad(F.col("record_idx").cast("string"), 12, "0")))
    n = F.length("sequence")
    # Letters are counted once, in columns of their own; the null model names each count dozens of times.
    rows = rows.withColumns({f"_{x}": letter_count(F.col("sequence"), x) for x in "ACGT"})
    share = {f"freq_{x}": F.col(f"_{x}") / n for x in "ACGT"}
    null = analytical_null(*(F.col(f"_{x}") for x in "ACGT"))
    return rows.select("rec", "record_id", "sequence", n.cast("long").alias("length"), *(c.alias(k) for k, c in share.items()), null.alias("null"))


def manifest(spark: SparkSession, out: str, sections: dict[str, dict]) -> None:
    """The parameter file ``out/params``: sections of plain values as TOML."""
    rows = [(params_toml(sections),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{out}/params")


def inputs(records: DataFrame) -> dict:
    """What a collection holds; its digest adds the hashes of its records, so it does not depend on how files are split."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\n", "record_id", "sequence").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    got = records.agg(F.count("*").alias("records"), F.sum("length").alias("residues"), F.sum(part).alias("digest")).first()
    return {k: int(v or 0) for k, v in got.asDict().items()}


def _text(rows: DataFrame, path: str, order: list[str], comments: list[str], lead: str | None = None) -> None:
    """Rows as TSV in the order of records; the columns of ``order`` are no fields."""
    sorted_rows = rows.repartitionByRange(order[0]).sortWithinPartitions(*order).drop(*order)
    write_tsv(sorted_rows, path, comments, lead, "overwrite")


def _arrays(profile: DataFrame, score: str) -> DataFrame:
    """``rec, record_id, base, v``: the scores of each record as one array from its first offset on."""
    rows = profile.groupBy("rec").agg(F.first("record_id").alias("record_id"), F.min("k").alias("base"), F.sort_array(F.collect_list(F.struct("k", F.col(score).alias("x")))).alias("s"))
    return rows.select("rec", "record_id", "base", F.transform("s", lambda p: p["x"]).alias("v"))


def _threshold(arrays: DataFrame, floor: float, mads: float | None) -> DataFrame:
    """``floor`` as the column ``threshold``, or the record's median and ``mads`` scaled MADs where that is more."""
    if mads is None:
        return arrays.withColumn("threshold", F.lit(float(floor)))

    def median(x: Column) -> Column:
        s, n = F.sort_array(x), F.size(x)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    finite = F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = arrays.withColumn("_m", median(finite)).withColumn("_d", median(F.transform(finite, lambda x: F.abs(x - F.col("_m")))))
    over = F.when(F.col("_d") > 0, F.greatest(F.lit(float(floor)), F.col("_m") + F.col("_d") * (mads * 1.4826))).otherwise(F.lit(float(floor)))
    return rows.withColumn("threshold", over).drop("_m", "_d")


def _peaks(arrays: DataFrame, path: str, cfg: PeaksConfig, mads: float | None, top: int | None, harmonics: bool) -> int:
    """Peaks of each record as TSV, after a line with its threshold, which a record without peaks has too; the number of peaks."""
    # Three outputs stand on these rows, which are on disk until then, so the table is read and searched once.
    ready = _threshold(arrays, cfg.min_score, mads).persist(StorageLevel.DISK_ONLY)
    shown = display_order(find_peaks(ready, "rec", "v", "base", cfg, "threshold"), "rec", top, harmonics).withColumnRenamed("row", "_row").persist(StorageLevel.DISK_ONLY)
    mode = "fixed" if mads is None else "mad"
    line = F.concat_ws(" ", F.concat(F.lit("diag record_id="), "record_id"), F.concat(F.lit("length="), F.size("v").cast("string")), F.concat(F.lit("threshold="), F.format_string("%.4f", "threshold")), F.lit(f"threshold_mode={mode} floor={cfg.min_score}"))
    told = ready.select("rec", "record_id", line.alias("_line"))
    try:
        fields = peak_fields(told.join(shown, "rec"), "rec", "_row", F.when(F.col("_row") == 1, F.col("_line")).alias("_lead"))
        _text(fields, path, ["rec", "_row"], [f"min_score={cfg.min_score} min_harmonics={cfg.min_harmonics}"], "_lead")
        # Records without peaks have no row to stand before.
        told.join(shown.select("rec"), "rec", "left_anti").select(F.concat(F.lit("# "), "_line").alias("value")).coalesce(1).write.mode("append").text(path)
        return shown.count()
    finally:
        shown.unpersist()
        ready.unpersist()


def run_periodogram(spark: SparkSession, fasta: str, out: str, cfg: PeriodogramConfig = PeriodogramConfig(window=None, factor=0), z: str = "off", shuffles: int = 200, seed: int = 0, fft_top: int | None = None, peaks: PeaksConfig | None = None) -> dict:
    """Periodograms of all records: ``out/periodogram`` (TSV) and ``out/profile`` (the same as Parquet), with ``fft_top`` also ``out/fft``, with ``peaks`` also ``out/peaks``.

    ``z`` is off, analytical, empirical or auto.  Records come in the order of
    their files, each after a line with its length, resolved window and factor, and letters.
    """
    out, mode = out.rstrip("/"), z_mode(z, cfg.white, cfg.black)
    records = sequences(spark, fasta)
    about = [f"freq_{x}" for x in "ACGT"]
    rows = periodogram(records, "rec", "sequence", cfg, ["record_id", "length", *about, "null"], told=True).withColumn("signal_mean", signal_mean())
    if mode == "empirical":
        scores = shuffle_null(records, "rec", "sequence", cfg, shuffles, seed).select("rec", "k", "z_score")
        rows = rows.join(scores, ["rec", "k"], "left")
    elif mode == "analytical":
        rows = rows.withColumn("z_score", analytical_z(F.col("null.mean"), F.col("null.variance"), F.col("factor")))
    elif mode == "off":
        rows = rows.withColumn("z_score", F.lit(float("nan")))
    else:
        raise ValueError(f"z is off, analytical, empirical or auto, not {z}")
    rows.write.mode("overwrite").parquet(f"{out}/profile")
    profile = spark.read.parquet(f"{out}/profile")
    number = lambda c: F.format_string("%.6f", F.col(c))
    named = [("record_id", F.col("record_id")), ("length", F.col("length")), ("window", F.col("window")), ("pixel_fac", F.col("factor")), *((x, number(x)) for x in about), ("null_mean", number("null.mean")), ("null_var", number("null.variance")), ("z", F.lit(mode))]
    line = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in named))
    lead = F.when(F.col("k") == F.min("k").over(Window.partitionBy("rec")), line)
    texts = periodogram_fields(profile, "rec", F.col("k").alias("_k"), lead.alias("_lead"))
    _text(texts, f"{out}/periodogram", ["rec", "_k"], [f"z={mode}"], "_lead")
    told = {"records": profile.select("rec").distinct().count(), "offsets": profile.count()}
    if fft_top is not None:
        bins = spectrum(_arrays(profile, "signal_mean"), "rec", "v")
        ranked = bins.join(rank_peaks(bins, "rec", fft_top).select("rec", "bin", "peak_rank"), ["rec", "bin"], "left").join(profile.groupBy("rec").agg(F.first("record_id").alias("record_id")), "rec")
        _text(spectrum_fields(ranked, "rec", F.col("bin").alias("_bin")), f"{out}/fft", ["rec", "_bin"], [f"top={fft_top}"])
        told["bins"] = bins.count()
    if peaks is not None:
        told["peaks"] = _peaks(_arrays(profile, "signal_mean"), f"{out}/peaks", peaks, None, None, False)
    manifest(spark, out, {"run": {"verb": "periodogram", "z": mode, "shuffles": shuffles, "seed": seed}, "scan": plain(cfg), "input": {"path": fasta, **inputs(records)}, "output": told})
    return told


def run_find_peaks(spark: SparkSession, tsv: str, out: str, cfg: PeaksConfig = PeaksConfig(), rank_by: str = "signal_mean", mads: float | None = None, top: int | None = None, harmonics: bool = False) -> dict:
    """Peaks of a periodogram or spectrum table, known by its header, as TSV in ``out/peaks``.

    Records come by their first line.  Offsets of a record must be dense.  ``mads`` sets each record's threshold by
    its own scores, with ``cfg.min_score`` as the floor; spectra have fixed thresholds, no sub-repeats, and the bins that were ranked.
    """
    out = out.rstrip("/")
    table = read_tsv(spark, tsv)
    kind = sniff(table.columns)
    rows = table.withColumn("rec", F.col("record_id"))
    if kind == "periodogram":
        if rank_by not in ("signal_mean", "z_score"):
            raise ValueError(f"rank_by is signal_mean or z_score, not {rank_by}")
        scores = rows.select("rec", "record_id", F.col("k").cast("long").alias("k"), F.col(rank_by).cast("double").alias("x"))
        told = {"peaks": _peaks(_arrays(check_dense(scores, "rec", "k"), "x"), f"{out}/peaks", cfg, mads, top, harmonics)}
    else:
        if mads is not None or cfg.subrepeat_min_score is not None:
            raise ValueError("spectra have fixed thresholds and no sub-repeats")
        ranked = rows.where(F.col("peak_rank") != "").select("rec", F.col("period_residues").cast("double").alias("period"), F.col("amplitude").cast("double").alias("amplitude"), F.col("peak_rank").cast("int").alias("peak_rank"))
        shown = display_order(find_bin_peaks(ranked, "rec", cfg), "rec", top, harmonics).withColumnsRenamed({"row": "_row"}).withColumn("record_id", F.col("rec"))
        _text(peak_fields(shown, "rec", "_row"), f"{out}/peaks", ["rec", "_row"], [f"min_score={cfg.min_score} min_harmonics={cfg.min_harmonics}"])
        told = {"peaks": shown.count()}
    manifest(spark, out, {"run": {"verb": "find-peaks", "kind": kind, "rank_by": rank_by, "mads": mads, "top": top, "harmonics": harmonics}, "peaks": plain(cfg), "input": {"path": tsv}, "output": told})
    return told


def _joined(spark: SparkSession, fasta: str) -> DataFrame:
    """The records of a collection one after another as one axis: ``text, length, alphabet, hint`` (the records' common length, if it has several)."""
    rows = sequences(spark, fasta)
    axis = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec", "sequence"))), lambda r: r["sequence"]), "").alias("text"), F.collect_set("length").alias("_l"), F.count("*").alias("_n"))
    common = gcd_of(F.col("_l"))
    return axis.select("text", F.length("text").cast("long").alias("length"), detect_alphabet(F.col("text")).alias("alphabet"), F.when((F.col("_n") > 1) & (common > 1), common).alias("hint"))


def _record_spans(spark: SparkSession, fasta: str, axis: str, zoom: int) -> DataFrame:
    """``plot, axis, name, start, stop`` of a collection's records in pixels of its axis."""
    rows = record_spans(sequences(spark, fasta).select(F.lit(0).alias("plot"), "rec", "record_id", "length"), ["plot"], "rec", F.col("length"))
    return rows.select("plot", F.lit(axis).alias("axis"), F.col("record_id").alias("name"), F.floor(F.col("start") / zoom).alias("start"), F.ceil(F.col("stop") / zoom).alias("stop"))


def zoom_of(q: Column, s: Column, q_hint: Column, s_hint: Column, self_plot: bool, target: int) -> Column:
    """The smallest zoom at which the larger side has ``target`` pixels at most, moved to a divisor of the records' common length where one is within a factor of two."""
    hints = zoom_period_hints(q_hint, s_hint, self_plot)
    base = auto_zoom(q, s, target)
    return F.when(F.size(hints) == 0, base).otherwise(snap_zoom(base, gcd_of(hints), 2.0))


def run_batch(spark: SparkSession, query: str, subject: str | None, out: str, cfg: PlotConfig = PlotConfig(window=None, factor=0, strand="both"), mode: str = "blastn", target: int | None = None, memory: int = MEMORY) -> dict:
    """A plot of two collections (or one against itself): ``out/pixels`` (Parquet), ``out/image`` (one PNG), ``out/svg`` (it, with axes and the records' names) and ``out/params``.

    A collection is the axis of its records, which must fit one row and whose
    image must fit ``memory`` bytes.  Letters of the other kind than the mode's
    (blastn or blastp) switch it, with the mode's scores; ``target`` picks the zoom.
    """
    if mode not in ("blastn", "blastp"):
        raise PlotError(f"mode is blastn or blastp, not {mode}")
    out = out.rstrip("/")
    q = _joined(spark, query)
    s = _joined(spark, subject) if subject else q
    facts = ["length", "alphabet", "hint"]
    a, b = q.select(*facts).first(), s.select(*facts).first()
    if not a["length"] or not b["length"]:
        raise PlotError("an axis without residues")
    whole = lambda x: F.lit(x).cast("long")
    zoom = zoom_of(whole(a["length"]), whole(b["length"]), whole(a["hint"]), whole(b["hint"]), subject is None, target) if target else whole(cfg.zoom)
    n = spark.range(1).select(zoom.alias("zoom"), mode_for(F.lit(a["alphabet"]), F.lit(mode)).alias("mode")).first()
    kind, scoring = n["mode"], Scoring() if n["mode"] == "blastn" else blosum62().scoring()
    used = replace(cfg, scoring=scoring, zoom=int(n["zoom"]), self_plot=subject is None, strand=cfg.strand if kind == "blastn" else "forward", memory_limit=memory)
    used.check_size(a["length"], b["length"])
    pair = q.select(F.lit(0).alias("plot"), F.col("text").alias("query")).join(s.select(F.lit(0).alias("plot"), F.col("text").alias("subject")), "plot")
    dotplot(pair, ["plot"], used).write.mode("overwrite").parquet(f"{out}/pixels")
    pixels = spark.read.parquet(f"{out}/pixels")
    shape = spark.range(1).select(F.lit(0).alias("plot"), image_dimension(F.lit(a["length"]), used.zoom).alias("width"), image_dimension(F.lit(b["length"]), used.zoom).alias("height"))
    summary = f"mode={kind} strand={used.strand} zoom={used.zoom} window={used.window or 'auto'} factor={used.factor or 'auto'}"
    image_files(pixels, shape, ["plot"], lambda image: png(image, text={"parameters": summary})).write.mode("overwrite").parquet(f"{out}/image")
    elements = mark_elements(axis_marks(shape, ["plot"], _record_spans(spark, query, "x", used.zoom).unionByName(_record_spans(spark, subject or query, "y", used.zoom))), ["plot"], 60).first()["elements"]
    image_files(pixels, shape, ["plot"], lambda image: svg(image, "", "", meta=summary, elements=elements, margin=60).encode()).write.mode("overwrite").parquet(f"{out}/svg")
    size = shape.first()
    told = {"width": size["width"], "height": size["height"], "lit": pixels.count()}
    manifest(spark, out, {"run": {"verb": "batch", "mode": kind}, "plot": plain(replace(used, scoring=Scoring())), "query": {"path": query, **inputs(sequences(spark, query))}, "subject": {"path": subject or query}, "output": told})
    return told


def plain(cfg) -> dict:
    """A configuration's values, nested ones as JSON."""
    return {k: json.dumps(v) if isinstance(v, dict | list | tuple) else v for k, v in asdict(cfg).items()}
