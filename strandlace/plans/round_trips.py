"""Further registered queries: files written and read back, statistics by letters, alignments, dense images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..functions import sequence as Q
from ..matrices import blosum62, dna_identity, parse_matrix
from ..operators import karlin as K
from ..operators import periodogram as P
from ..operators import ridges as R
from ..operators.kernel import Scoring
from ..operators.peaks import PeaksConfig, find_bin_peaks
from ..operators.tiled_periodogram import cells_of_records, tiled_periodogram
from ..operators.spectrum import rank_peaks, spectrum
from ..session import options, scratch
from ..sources.fasta import fasta_text, read_fasta_records
from ..sources.fasta_chunks import read_fasta_chunks, whole_records
from ..sources.images import IMAGE_FILES, DotFile, image_file, image_pixels, png, read_dot, read_png
from ..sources.tables import check_dense, periodogram_fields, read_tsv, spectrum_fields, write_tsv
from .catalogue import DNA_SQL, FORWARD_SQL, HOURLY_SQL, KEY, MAX_SQL, NULL_SQL, ORACLES, PAIRS_SQL, PART_PAIRS_SQL, PG, PG_SQL, TURN_SQL, _classified, _dft_sql, _dna, _hourly, _matrix_values, _pg, _plot_sql, _read, _turn_pairs, query, adjacent, part_pairs, SPANS_SQL, _spans
from . import verbs as V
from .axes import axis_marks
from .dotplot import PlotConfig, dotplot, drawn_dotplot
from .plot_store import PlotStore, rect_zoom

PROTEIN_SQL = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


# --- files -------------------------------------------------------------------------------------


@query("fasta_roundtrip", ORACLES["fasta_split"])
def _(spark, d):
    """Documents written as FASTA files and read back."""
    path = scratch(spark)
    rows = _read(spark, d, "documents").select("doc_id", "lang", Q.protein_view(F.col("text")).alias("seq")).where("length(seq) > 0")
    rows.select(fasta_text(F.col("doc_id").cast("string"), F.col("lang"), F.col("seq")).alias("value")).write.text(path)
    return read_fasta_records(spark, path).select("record_id", "description", "sequence")


@query("fasta_chunks", f"SELECT CAST(doc_id AS VARCHAR) AS record_id, lang AS description, CAST(length(seq) AS BIGINT) AS length, sha256(seq) AS sha FROM (SELECT doc_id, lang, {PROTEIN_SQL} AS seq FROM documents) WHERE length(seq) > 0")
def _(spark, d):
    """Documents written as FASTA files, whose records are read in blocks of 64 KiB that cut them anywhere, and put together."""
    path, chunks = scratch(spark), scratch(spark)
    rows = _read(spark, d, "documents").select("doc_id", "lang", Q.protein_view(F.col("text")).alias("seq")).where("length(seq) > 0")
    rows.select(fasta_text(F.col("doc_id").cast("string"), F.col("lang"), F.col("seq")).alias("value")).write.text(path)
    with options(spark, **{"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "4k"}):
        read_fasta_chunks(spark, path, 10_000).write.parquet(chunks)
    found = whole_records(spark.read.parquet(chunks))
    return found.select("record_id", "description", F.length("sequence").cast("long").alias("length"), F.sha2(F.col("sequence").cast("binary"), 256).alias("sha"))


@query("tsv_roundtrip", ORACLES["pg_tsv_fields"])
def _(spark, d):
    """Periodograms written as TSV files with comments and read back."""
    path = scratch(spark)
    rows = _pg(spark, d).select(F.col("doc_id").alias("record_id"), "k", "raw_sum", "signal_sum", P.signal_mean().alias("signal_mean"), F.lit(float("nan")).alias("z_score"))
    write_tsv(periodogram_fields(rows), path, ["window=8 pixel_factor=12", "offsets 3 to 12"])
    return read_tsv(spark, path)


def _sizes(pairs):
    n = lambda c: F.length(c).cast("long")
    return pairs.select(*KEY, n("query").alias("width"), n("subject").alias("height"))


@query("dot_file_roundtrip", FORWARD_SQL)
def _(spark, d):
    """Plots written as binary plot files and read back."""
    draw = image_file(lambda image: DotFile(1.0, image, 12, 8, "DNA").to_bytes())
    files = drawn_dotplot(_turn_pairs(spark, d), KEY, draw, IMAGE_FILES, whole=True)
    return image_pixels(files, KEY, lambda data: read_dot(data).image)


@query("png_roundtrip", FORWARD_SQL)
def _(spark, d):
    """Plots written as PNG images and read back."""
    pairs = _turn_pairs(spark, d).where("length(query) > 0 and length(subject) > 0")
    files = drawn_dotplot(pairs, KEY, image_file(lambda image: png(image, text={"window": "8"})), IMAGE_FILES, whole=True)
    return image_pixels(files, KEY, lambda data: read_png(data)[0])


@query("render_sized", f"""
WITH px AS ({FORWARD_SQL}), z AS (SELECT conv_id, turn, length(query) AS w, length(subject) AS h FROM ({TURN_SQL}) WHERE length(query) > 0 AND length(subject) > 0),
xs AS (SELECT conv_id, turn, x, x * w // 90 AS px FROM z, (SELECT unnest(range(0, 90)) AS x)), ys AS (SELECT conv_id, turn, y, y * h // 60 AS py FROM z, (SELECT unnest(range(0, 60)) AS y))
SELECT conv_id, turn, x, y, CAST(CASE WHEN value <= 10 THEN 255 WHEN value >= 60 THEN 0 ELSE floor(255.5 - (value - 10) * 255.0 / 50) END AS INT) AS grey FROM px JOIN xs USING (conv_id, turn, px) JOIN ys USING (conv_id, turn, py)""")
def _(spark, d):
    """Plots drawn into images of 90 by 60 pixels."""
    pairs = _turn_pairs(spark, d)
    return R.render_sized(dotplot(pairs, KEY), _sizes(pairs), KEY, 90, 60, 10, 60)


@query("matrix_text_roundtrip", f"WITH m(matrix, row, col, score) AS (VALUES {_matrix_values()}) SELECT m.*, coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT r AS row, c AS col, count(*) AS n FROM ({PART_PAIRS_SQL}) GROUP BY ALL) USING (row, col)")
def _(spark, d):
    """Each cell of a matrix, written as text and parsed, with the neighbours in parts' names that meet it."""
    met = part_pairs(spark, d).groupBy("row", "col").agg(F.count("*").alias("n"))
    return parse_matrix(blosum62().to_text(), "BLOSUM62").frame(spark).join(met, ["row", "col"], "left").select("matrix", "row", "col", "score", F.coalesce("n", F.lit(0)).alias("n"))


ITEMS_SQL = f"SELECT item_id AS id, {DNA_SQL} AS t FROM benchmark"


@query("matrix_dna", f"""
SELECT 'DNA+5/-4' AS matrix, CAST(strpos('ACGT', b) - 1 AS INT) AS row, CAST(strpos('ACGT', a) - 1 AS INT) AS col, CASE WHEN a = b THEN 5 ELSE -4 END AS score, count(*) AS n
FROM ({PAIRS_SQL.format(source=ITEMS_SQL)}) GROUP BY ALL""")
def _(spark, d):
    """The cells of a DNA matrix, written as text and parsed, that neighbouring letters of the items meet."""
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), Q.dna_view(F.col("text")).alias("t"))
    met = adjacent(items, "t").groupBy(Q.encode_letter(F.col("b"), "ACGT").alias("row"), Q.encode_letter(F.col("a"), "ACGT").alias("col")).agg(F.count("*").alias("n"))
    return met.join(F.broadcast(parse_matrix(dna_identity().to_text(), "DNA+5/-4", "ACGT").frame(spark)), ["row", "col"]).select("matrix", "row", "col", "score", "n")


@query("pg_position_cells", PG_SQL + " SELECT doc_id, k, raw_sum, signal_sum, n_pairs FROM pg")
def _(spark, d):
    """Each document in cells of 1,000 letters, whose partial sums are added by Spark."""
    return tiled_periodogram(cells_of_records(_dna(spark, d), "doc_id", "seq", PG, 1000), "doc_id", PG, 1000)


@query("dense_check", PG_SQL + " SELECT doc_id, k, raw_sum FROM pg")
def _(spark, d):
    return check_dense(_pg(spark, d).select("doc_id", "k", "raw_sum"), "doc_id", "k")


@query("fft_tsv_fields", _dft_sql(HOURLY_SQL) + " SELECT key AS record_id, CAST(bin AS VARCHAR) AS bin, printf('%.6f', bin / p) AS frequency, CASE WHEN bin = 0 THEN 'inf' ELSE printf('%.4f', p / bin) END AS period_residues FROM amp JOIN l USING (key)")
def _(spark, d):
    out = spectrum_fields(_hourly(spark, d).withColumn("record_id", F.col("key")).withColumn("peak_rank", F.lit(None)))
    return out.select("record_id", "bin", "frequency", "period_residues")


# --- letters and statistics --------------------------------------------------------------------


@query("seq_encode_protein", f"""
SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN strpos('{Q.PROTEIN}', translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) > 0
    THEN CAST(strpos('{Q.PROTEIN}', translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) - 1 AS INT) ELSE 255 END AS code
  FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM benchmark)) GROUP BY code""")
def _(spark, d):
    letters = _read(spark, d, "benchmark").select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c"))
    return letters.select(F.coalesce(Q.encode_letter(F.col("c"), Q.PROTEIN), F.lit(255)).cast("int").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


FREQ_SQL = f"""SELECT item_id, CAST(strpos('{Q.PROTEIN}', c) - 1 AS INT) AS code, count(*) / sum(count(*)) OVER (PARTITION BY item_id) AS share
  FROM (SELECT item_id, unnest(regexp_extract_all(upper(text), '[A-Z*]')) AS c FROM benchmark) WHERE strpos('{Q.PROTEIN}', c) > 0 GROUP BY item_id, c"""


def _protein_freqs(spark, d):
    items = _read(spark, d, "benchmark").select("item_id", Q.ascii_upper(F.regexp_replace("text", "[^A-Za-z*]", "")).alias("seq"))
    return items.select("item_id", K.residue_frequencies(F.col("seq"), Q.PROTEIN).alias("fq"))


@query("residue_frequencies", f"SELECT item_id, code, round(share, 9) AS share FROM ({FREQ_SQL})")
def _(spark, d):
    rows = _protein_freqs(spark, d).select("item_id", F.posexplode("fq").alias("code", "share"))
    return rows.where("share > 0").select("item_id", "code", F.round("share", 9).alias("share"))


@query("score_histogram", f"""
WITH f AS ({FREQ_SQL}), m(matrix, r, c, score) AS (VALUES {_matrix_values()})
SELECT a.item_id, score, round(sum(a.share * b.share), 9) AS p FROM f a JOIN f b ON a.item_id = b.item_id JOIN m ON m.r = a.code AND m.c = b.code GROUP BY a.item_id, score""")
def _(spark, d):
    freqs = _protein_freqs(spark, d).withColumn("fs", F.col("fq"))
    return K.score_histogram(freqs, ["item_id"], blosum62().frame(spark).drop("matrix")).select("item_id", "score", F.round("p", 9).alias("p"))


def _turn_freqs(spark, d):
    pairs = _turn_pairs(spark, d)
    return pairs.select(*KEY, K.residue_frequencies(F.col("query"), "ACGT").alias("fq"), K.residue_frequencies(F.col("subject"), "ACGT").alias("fs"))


_SHARE = lambda c: f"(length({c}) - length(replace({c}, '%s', ''))) / length({c})"
_SAME = " + ".join(f"({_SHARE('query') % x}) * ({_SHARE('subject') % x})" for x in "ACGT")


@query("karlin_expected_score", f"SELECT conv_id, turn, round(5 * same - 4 * (1 - same), 6) AS expected FROM (SELECT conv_id, turn, {_SAME} AS same FROM ({TURN_SQL}) WHERE length(query) > 0 AND length(subject) > 0)")
def _(spark, d):
    rows = K.score_histogram(_turn_freqs(spark, d), KEY, dna_identity().frame(spark).drop("matrix"))
    return rows.groupBy(*KEY).agg(F.round(F.sum(F.col("score") * F.col("p")), 6).alias("expected"))


@query("karlin_window")
def _(spark, d):
    """Lambda, K, H, the expected MSP, window and pixel factor of each pair of turns."""
    return K.karlin_statistics(_turn_freqs(spark, d), KEY, Q_DNA)


Q_DNA = [list(r) for r in dna_identity().rows]


@query("dot_automatic")
def _(spark, d):
    """Plots whose window and pixel factor follow from each pair's letters."""
    return dotplot(_turn_pairs(spark, d), KEY, PlotConfig(window=None, factor=0))


# --- signals -----------------------------------------------------------------------------------

IDENTITY = P.PeriodogramConfig(window=8, factor=12, min_offset=3, max_offset=12, white=0, black=255)


@query("pg_identity_ramp", PG_SQL + " SELECT doc_id, k, raw_sum, raw_sum AS signal_sum FROM pg")
def _(spark, d):
    return P.periodogram(_dna(spark, d), "doc_id", "seq", IDENTITY).select("doc_id", "k", "raw_sum", "signal_sum")


DAILY_SQL = "SELECT l_returnflag AS key, row_number() OVER (PARTITION BY l_returnflag ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n, CAST(c AS DOUBLE) AS x FROM (SELECT l_returnflag, date_trunc('day', l_shipdate) AS d, count(*) AS c FROM lineitem GROUP BY ALL)"


@query("fft_daily_lineitem", _dft_sql(DAILY_SQL) + " SELECT key, CAST(bin AS BIGINT) AS bin, round(amplitude, 3) AS amplitude FROM amp")
def _(spark, d):
    days = _read(spark, d, "lineitem").groupBy("l_returnflag", F.date_trunc("day", "l_shipdate").alias("d")).agg(F.count("*").alias("c"))
    series = days.groupBy("l_returnflag").agg(F.sort_array(F.collect_list(F.struct("d", "c"))).alias("s"))
    out = spectrum(series.select(F.col("l_returnflag").alias("key"), F.transform("s", lambda x: x["c"]).alias("v")), "key", "v")
    return out.select("key", "bin", F.round("amplitude", 3).alias("amplitude"))


@query("fft_top_peak", _dft_sql(HOURLY_SQL) + """, f AS (SELECT *, lag(amplitude) OVER o AS p, lead(amplitude) OVER o AS n FROM amp WINDOW o AS (PARTITION BY key ORDER BY bin))
SELECT key, CAST(bin AS BIGINT) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY amplitude DESC, bin) AS r FROM f WHERE amplitude > p AND amplitude > n) WHERE r = 1""")
def _(spark, d):
    return rank_peaks(_hourly(spark, d), "key", 1).select("key", "bin")


@query("peaks_subrepeats")
def _(spark, d):
    """Sub-repeats of the documents' fundamental periods."""
    return _classified(spark, d).where("kind = 'subrepeat'").select("doc_id", "period", "score", "parent", "divisor_n")


@query("peaks_of_spectrum")
def _(spark, d):
    """Classified peaks of the hourly spectra's ranked bins."""
    return find_bin_peaks(rank_peaks(_hourly(spark, d), "key", 20), "key", PeaksConfig(min_score=0.0, min_harmonics=0))


# --- alignments and images ---------------------------------------------------------------------

WINDOW_CELL = "CASE WHEN q < 0 OR q >= length(a) OR {s} < 0 OR {s} >= length(b) THEN 0 WHEN substr(a, q + 1, 1) = {c} THEN 5 ELSE -4 END"
WINDOW_SQL = f"""
WITH t AS (SELECT item_id, {DNA_SQL} AS a, reverse({DNA_SQL}) AS b FROM benchmark), m AS (SELECT *, length(a) // 2 AS qm, length(a) // 3 AS sm FROM t),
k AS (SELECT *, qm - 4 + k AS q, sm - 4 + k AS s, sm + 4 - k AS r FROM m, (SELECT unnest(range(0, 9)) AS k))
SELECT item_id, CAST(sum({WINDOW_CELL.format(s="s", c="substr(b, s + 1, 1)")}) AS BIGINT) AS forward,
  CAST(sum({WINDOW_CELL.format(s="r", c="translate(substr(b, r + 1, 1), 'ACGT', 'TGCA')")}) AS BIGINT) AS reverse FROM k GROUP BY item_id"""


def _middles(spark, d):
    t = _read(spark, d, "benchmark").select("item_id", Q.dna_view(F.col("text")).alias("a")).withColumn("b", F.reverse("a"))
    return t.withColumn("qm", S.div(F.length("a"), F.lit(2))).withColumn("sm", S.div(F.length("a"), F.lit(3)))


@query("window_score", f"SELECT *, greatest(forward, reverse) AS both FROM ({WINDOW_SQL})")
def _(spark, d):
    at = lambda strand: Q.window_score(F.col("a"), F.col("b"), F.col("qm"), F.col("sm"), 9, dna_identity().scoring(), strand)
    return _middles(spark, d).select("item_id", *(at(s).alias(s) for s in ("forward", "reverse", "both")))


@query("align_classes", f"""
WITH t AS (SELECT item_id, {PROTEIN_SQL} AS a, reverse({PROTEIN_SQL}) AS b FROM benchmark), m(matrix, r, c, score) AS (VALUES {_matrix_values()}),
k AS (SELECT item_id, CAST(k AS BIGINT) AS col, length(a) AS n, CASE WHEN k - 20 >= 0 AND k - 20 < length(a) THEN substr(a, k - 19, 1) ELSE '-' END AS q, CASE WHEN 2 + k - 20 >= 0 AND 2 + k - 20 < length(b) THEN substr(b, k - 17, 1) ELSE '-' END AS s FROM t, (SELECT unnest(range(0, 41)) AS k))
SELECT item_id, col, q, s, CASE WHEN q = '-' OR s = '-' THEN 'OutOfBounds' WHEN q = s THEN 'Identical' WHEN coalesce(score, 0) > 0 THEN 'Positive' ELSE 'Other' END AS class, CASE WHEN q = '-' OR s = '-' THEN 0 ELSE coalesce(score, 0) END AS score
FROM k LEFT JOIN m ON r = strpos('{Q.PROTEIN}', s) - 1 AND c = strpos('{Q.PROTEIN}', q) - 1""")
def _(spark, d):
    """41 columns around a crosshair near the start, so that some lie outside."""
    t = _read(spark, d, "benchmark").select("item_id", Q.protein_view(F.col("text")).alias("a")).withColumn("b", F.reverse("a"))
    cols = Q.alignment_columns(F.col("a"), F.col("b"), F.lit(0), F.lit(2), 41, blosum62().scoring())
    return t.select("item_id", F.posexplode(cols).alias("col", "x")).select("item_id", F.col("col").cast("long").alias("col"), "x.q", "x.s", "x.class", "x.score")


def _clipboard_sql(window: int) -> str:
    half = window // 2
    letter = lambda x, pos: f"substr({x}, CAST({pos} + 1 AS BIGINT), 1)"
    each = lambda e: f"array_to_string(list_transform(range(0, {window}), lambda k: {e}), '')"
    row = lambda name, first, text, last: f"'{name:<9}5'' ' || lpad(CAST({first} AS VARCHAR), 8, ' ') || ' ' || {text} || ' ' || rpad(CAST({last} AS VARCHAR), 8, ' ') || ' 3''' || chr(10)"

    def block(reverse: bool) -> str:
        q_pos, s_pos = f"(qm - {half} + k)", f"(sm + {half} - k)" if reverse else f"(sm - {half} + k)"
        q_out, s_out = f"({q_pos} < 0 OR {q_pos} >= length(query))", f"({s_pos} < 0 OR {s_pos} >= length(subject))"
        a, b = letter("query", q_pos), letter("subject", s_pos)
        b = f"translate({b}, 'ACGT', 'TGCA')" if reverse else b
        q_text, s_text = each(f"CASE WHEN {q_out} THEN '-' ELSE {a} END"), each(f"CASE WHEN {s_out} THEN '-' ELSE {b} END")
        marks = each(f"CASE WHEN NOT {q_out} AND NOT {s_out} AND {a} = {b} THEN '|' ELSE ' ' END")
        s0, s1 = (f"sm + {half + 1}", f"sm + {half - window + 2}") if reverse else (f"sm - {half - 1}", f"sm - {half - window}")
        return f"{row('query', f'qm - {half - 1}', q_text, f'qm - {half - window}')} || repeat(' ', 20) || {marks} || chr(10) || {row('subject', s0, s_text, s1)}"

    return f"""
SELECT conv_id, turn, 'q = ' || (qm + 1) || '   s = ' || (sm + 1) || '   window = {window}' || chr(10) || chr(10) || '+/+' || chr(10) || {block(False)} || chr(10) || '+/-' || chr(10) || {block(True)} AS text
FROM (SELECT *, CAST(length(query) // 3 AS BIGINT) AS qm, CAST(length(subject) // 2 AS BIGINT) AS sm FROM ({TURN_SQL}))"""


@query("align_clipboard", _clipboard_sql(31))
def _(spark, d):
    """The alignments around a place of each pair of turns, both strands, as text."""
    mid = lambda c, n: S.div(F.length(c), F.lit(n))
    return _turn_pairs(spark, d).select(*KEY, Q.clipboard_text(F.col("query"), F.col("subject"), mid("query", 3), mid("subject", 2), 31, Scoring(), True).alias("text"))


@query("align_text", """
WITH t AS (SELECT item_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS a FROM benchmark), c AS (SELECT item_id, 'item' || item_id AS qn, 'rev' AS sn, substr(a, 11, 130) AS q, substr(reverse(a), 11, 130) AS s FROM t)
SELECT item_id, '>' || qn || ':11..' || (10 + length(q)) || ' (length ' || length(q) || ')' || chr(10) || CASE WHEN length(q) > 0 THEN array_to_string(list_transform(range(0, CAST(ceil(length(q) / 60) AS BIGINT)), lambda i: substr(q, 60 * i + 1, 60)), chr(10)) || chr(10) ELSE '' END
  || '>' || sn || ':11..' || (10 + length(s)) || ' (length ' || length(s) || ')' || chr(10) || CASE WHEN length(s) > 0 THEN array_to_string(list_transform(range(0, CAST(ceil(length(s) / 60) AS BIGINT)), lambda i: substr(s, 60 * i + 1, 60)), chr(10)) || chr(10) ELSE '' END AS fasta,
  '# STOCKHOLM 1.0' || chr(10) || rpad(qn, CAST(length(qn) + 2 AS INT), ' ') || q || chr(10) || rpad(sn, CAST(length(qn) + 2 AS INT), ' ') || s || chr(10) || '//' || chr(10) AS stockholm,
  rpad(qn || ':', CAST(length(qn) + 2 AS INT), ' ') || q || chr(10) || rpad(sn || ':', CAST(length(qn) + 2 AS INT), ' ') || s || chr(10) AS plain FROM c""")
def _(spark, d):
    t = _read(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("a"))
    c = t.select("item_id", F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("qn"), F.lit("rev").alias("sn"), F.substring("a", 11, 130).alias("q"), F.substring(F.reverse("a"), 11, 130).alias("s"))
    text = lambda kind: L.alignment_text(kind, F.col("qn"), F.col("q"), F.col("sn"), F.col("s"), F.lit(10), F.lit(10)).alias(kind)
    return c.select("item_id", *(text(k) for k in ("fasta", "stockholm", "plain")))


@query("argmax_snap", f"""
WITH lit AS ({FORWARD_SQL}), c AS (SELECT conv_id, turn, length(query) // 2 AS cx, length(subject) // 2 AS cy FROM ({TURN_SQL}))
SELECT conv_id, turn, px, py, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY value DESC, (px - cx) * (px - cx) + (py - cy) * (py - cy), py, px) AS r FROM lit JOIN c USING (conv_id, turn) WHERE abs(px - cx) <= 64 AND abs(py - cy) <= 64) WHERE r = 1""")
def _(spark, d):
    pairs = _turn_pairs(spark, d)
    middle = pairs.select(*KEY, S.div(F.length("query"), F.lit(2)).alias("cx"), S.div(F.length("subject"), F.lit(2)).alias("cy"))
    return R.snap(dotplot(pairs, KEY), middle, KEY)


@query("nice_step", """
SELECT o_orderkey, CAST(CASE WHEN t < 1 THEN 1 WHEN b >= t THEN b WHEN 2 * b >= t THEN 2 * b WHEN 5 * b >= t THEN 5 * b ELSE 10 * b END AS BIGINT) AS step
FROM (SELECT o_orderkey, t, pow(10, floor(log10(greatest(t, 1)))) AS b FROM (SELECT o_orderkey, (o_orderkey * 37 % 100003) / 8 AS t FROM orders))""")
def _(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", L.nice_step(F.col("o_orderkey") * 37 % 100003).alias("step"))


@query("render_dense", f"""
WITH px AS ({FORWARD_SQL}), sz AS (SELECT conv_id, turn, length(query) AS w, length(subject) AS h FROM ({TURN_SQL}) WHERE length(query) > 0 AND length(subject) > 0),
g AS (SELECT conv_id, turn, CAST(px AS BIGINT) AS px, CAST(unnest(range(0, h)) AS BIGINT) AS py FROM (SELECT *, unnest(range(0, w)) AS px FROM sz))
SELECT conv_id, turn, py, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN coalesce(value, 0) <= 10 THEN 255 WHEN value >= 60 THEN 0 ELSE floor(255.5 - (value - 10) * 255.0 / 50) END) AS BIGINT) AS grey FROM g LEFT JOIN px USING (conv_id, turn, px, py) GROUP BY ALL""")
def _(spark, d):
    """Every pixel of every image through the grey ramp, summed by image row."""
    return drawn_dotplot(_turn_pairs(spark, d), KEY, R.grey_rows(10, 60), R.GREY_ROWS)


# --- views of stored plots ---------------------------------------------------------------------


def _views(spark, d, cfg: PlotConfig):
    """The middle half of each pair of turns, drawn on a plot of the whole, for a canvas of 40 by 30 pixels."""
    store = PlotStore(spark, scratch(spark), cfg)
    pairs = store.named(_turn_pairs(spark, d))
    store.add(pairs)
    sized = pairs.select(*KEY, "plot", F.length("query").cast("long").alias("qlen"), F.length("subject").cast("long").alias("slen"))
    whole = F.struct(F.lit(0).cast("long").alias("q_start"), F.lit(0).cast("long").alias("s_start"), F.lit(1).cast("long").alias("zoom"))
    quarter = lambda c, k: S.div(F.col(c) * k, F.lit(4))
    view = rect_zoom(quarter("qlen", 1), quarter("qlen", 3), quarter("slen", 1), quarter("slen", 3), whole, F.col("qlen"), F.col("slen"), 40, 30)
    views = sized.select(*KEY, "plot", view.alias("v")).where("v is not null").select(*KEY, "plot", "v.*").drop("x", "y")
    return store.views(views).select(*KEY, "zoom", "px", "py", "value")


def _view_sql(reverse: bool) -> str:
    def axis(c: str, x: str) -> str:
        return f"length({c}) // 4 AS {x}a, greatest(1, 3 * length({c}) // 4 - length({c}) // 4) AS {x}w, 3 * length({c}) // 4 AS {x}b, CAST(ceil({x}w * 0.5) AS BIGINT) AS {x}m, greatest(0, {x}a - {x}m) AS {x}0, least(length({c}), {x}b + {x}m) AS {x}1"

    slices = f"""
SELECT conv_id, turn, greatest(1, CAST(ceil(qw / 40) AS BIGINT), CAST(ceil(sw / 30) AS BIGINT)) AS zoom, substr(query, q0 + 1, q1 - q0) AS query, substr(subject, s0 + 1, s1 - s0) AS subject
FROM (SELECT *, {axis("query", "q")}, {axis("subject", "s")} FROM ({TURN_SQL})) WHERE qb - qa >= 3 AND sb - sa >= 3"""
    return _plot_sql(slices, "conv_id, turn", 8, 12, "zoom", reverse).replace("SELECT conv_id, turn, CAST(cq", "SELECT conv_id, turn, zoom, CAST(cq")


@query("rect_zoom", _view_sql(False))
def _(spark, d):
    return _views(spark, d, PlotConfig())


@query("rect_zoom_reverse", _view_sql(True))
def _(spark, d):
    return _views(spark, d, PlotConfig(strand="reverse"))


# --- whole runs --------------------------------------------------------------------------------


def _fasta_folder(spark, d) -> str:
    """Documents as FASTA files of DNA letters."""
    path = scratch(spark)
    _dna(spark, d).where("length(seq) > 0").select(fasta_text(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("seq")).alias("value")).write.text(path)
    return path


@query("verb_periodogram", PG_SQL + f""", nul AS ({NULL_SQL})
SELECT CAST(pg.doc_id AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS k, CAST(raw_sum AS VARCHAR) AS raw_sum, CAST(signal_sum AS VARCHAR) AS signal_sum,
  round(CASE WHEN n_pairs > 0 THEN signal_sum / n_pairs ELSE 0 END, 6) AS signal_mean, round(CASE WHEN n_pairs = 0 OR sqrt(n_pairs * 144.0 * variance) <= 2.220446049250313e-16 THEN 0 ELSE (raw_sum - n_pairs * 12 * mean) / sqrt(n_pairs * 144.0 * variance) END, 4) AS z_score
FROM pg JOIN nul USING (doc_id)""")
def _(spark, d):
    """FASTA files to TSV files with analytical scores, read back."""
    out = scratch(spark)
    V.run_periodogram(spark, _fasta_folder(spark, d), out, PG, "analytical")
    number = lambda c, n: F.round(F.col(c).cast("double"), n).alias(c)
    return read_tsv(spark, f"{out}/periodogram").select("record_id", "k", "raw_sum", "signal_sum", number("signal_mean", 6), number("z_score", 4))


@query("verb_find_peaks", MAX_SQL + """, md AS (SELECT doc_id, quantile_cont(score, 0.5) AS med FROM sc GROUP BY doc_id),
dv AS (SELECT doc_id, any_value(med) AS med, quantile_cont(abs(score - med), 0.5) AS mad FROM sc JOIN md USING (doc_id) GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS period_bp FROM mx JOIN dv USING (doc_id) WHERE k <= 10 AND score >= CASE WHEN mad > 0 THEN greatest(1.0, med + mad * (2.0 * 1.4826)) ELSE 1.0 END""")
def _(spark, d):
    """FASTA files to periodogram files to peak files, with each record's own threshold; all peaks, whatever their kind."""
    first, out = scratch(spark), scratch(spark)
    V.run_periodogram(spark, _fasta_folder(spark, d), first, PG)
    V.run_find_peaks(spark, f"{first}/periodogram", out, PeaksConfig(min_score=1.0, min_harmonics=0), mads=2.0, harmonics=True)
    return read_tsv(spark, f"{out}/peaks").select("record_id", "period_bp")


# --- axes --------------------------------------------------------------------------------------


def _nice_sql(n: str) -> str:
    base = f"pow(10, floor(log10(greatest({n} / 8.0, 1.0))))"
    return f"CAST(CASE WHEN {n} / 8.0 < 1 THEN 1 WHEN {base} >= {n} / 8.0 THEN {base} WHEN 2 * {base} >= {n} / 8.0 THEN 2 * {base} WHEN 5 * {base} >= {n} / 8.0 THEN 5 * {base} ELSE 10 * {base} END AS BIGINT)"


@query("axis_marks", f"""
WITH s AS ({SPANS_SQL}), a AS (SELECT conv_id, unnest(['x', 'y']) AS axis, unnest([max(stop), max(stop) // 3]) AS size FROM s GROUP BY conv_id), st AS (SELECT *, {_nice_sql("size")} AS step FROM a),
t AS (SELECT conv_id, axis, 'major' AS kind, unnest(range(0, size + 1, step)) AS t FROM st UNION ALL SELECT conv_id, axis, 'minor', unnest(range(0, size + 1, step // 5)) FROM st WHERE step >= 5)
SELECT conv_id, axis, kind, CAST(t AS DOUBLE) AS at, CASE WHEN kind = 'major' THEN CASE WHEN t >= 1000000 THEN printf('%.1fM', t / 1e6) WHEN t >= 10000 THEN CAST(t // 1000 AS VARCHAR) || 'k' WHEN t >= 1000 THEN printf('%.1fk', t / 1e3) ELSE CAST(t AS VARCHAR) END END AS label FROM t
UNION ALL SELECT s.conv_id, axis, 'record', (start + least(stop, size)) / 2.0, role || ' ' || s.turn FROM s JOIN a USING (conv_id) JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn
WHERE stop > start AND start < size AND least(stop, size) - start >= CASE axis WHEN 'x' THEN 18 ELSE 12 END""")
def _(spark, d):
    """Axes of conversations against themselves, a third of the height, with the turns as records."""
    spans = _spans(spark, d).select("conv_id", "start", "stop", F.concat_ws(" ", "role", "turn").alias("name"))
    sizes = spans.groupBy("conv_id").agg(F.max("stop").alias("width"), S.div(F.max("stop"), F.lit(3)).alias("height"))
    return axis_marks(sizes, ["conv_id"], spans.withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y")))))
