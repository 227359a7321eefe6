"""Exact small fixtures of the sequence engine."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlace.functions import labels, scores, sequence
from strandlace.matrices import blosum62, by_name, custom_dna, dna_identity, parse_matrix
from strandlace.operators import karlin, kernel, peaks, periodogram, ridges, shuffles, spectrum, tiles
from strandlace.operators.kernel import Scoring
from strandlace.plans.dotplot import PlotConfig, PlotError, dotplot, translated_dotplot
from strandlace.sources import fasta, images, sessions, tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def recurrence(q, s, w, z, pf, strand, self_plot=False):
    """A literal evaluation of the plot rules in plain Python."""
    comp = {"A": "T", "T": "A", "C": "G", "G": "C"}
    score = lambda a, b: 0 if a not in comp or b not in comp else 5 if a == b else -4
    out = {}
    for i in range(w, len(q)):
        for j in range(w, len(s)) if strand == "forward" else range(0, len(s) - w):
            if self_plot and i > j:
                continue
            v = sum(score(q[i - k], s[j - k]) if strand == "forward" else score(comp.get(q[i - k], "N"), s[j + k]) for k in range(w))
            if v <= 0:
                continue
            cq, cs = i - w // 2, j - w // 2 if strand == "forward" else j + w // 2
            if not (cs % z >= cq % z if strand == "forward" else z - 1 - cs % z >= cq % z):
                continue
            px, py = cq // z, cs // z
            if px < -(-len(q) // z) and py < -(-len(s) // z):
                out[px, py] = max(out.get((px, py), 0), min(255, v * pf // w))
    return out


def pixels(df):
    return {(r["px"], r["py"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("strand", ["forward", "reverse"])
def test_plans_equal_recurrence(spark, strand):
    rng = random.Random(7)
    for case in range(4):
        q, s = ("".join(rng.choice("ACGTN" if case % 2 else "ACGT") for _ in range(rng.randint(3, 45))) for _ in range(2))
        w, z = rng.randint(1, 6), rng.randint(1, 4)
        pairs = spark.createDataFrame([(1, q, s)], "id long, query string, subject string")
        want = recurrence(q, s, w, z, 12, strand)
        for plan in ("block", "relational"):
            assert pixels(dotplot(pairs, ["id"], PlotConfig(window=w, zoom=z, strand=strand, plan=plan))) == want, (plan, q, s, w, z)


def test_self_plots_and_strands(spark):
    rng = random.Random(3)
    q = "".join(rng.choice("ACGT") for _ in range(60))
    pairs = spark.createDataFrame([(1, q, q)], "id long, query string, subject string")
    lower = recurrence(q, q, 6, 1, 20, "forward", True)
    base = dict(window=6, factor=20, self_plot=True)
    assert pixels(dotplot(pairs, ["id"], PlotConfig(**base, triangle="lower"))) == lower
    assert pixels(dotplot(pairs, ["id"], PlotConfig(**base, triangle="upper"))) == {(y, x): v for (x, y), v in lower.items()}
    assert pixels(dotplot(pairs, ["id"], PlotConfig(**base))) == lower | {(y, x): v for (x, y), v in lower.items()}
    split = dotplot(pairs, ["id"], PlotConfig(window=6, strand="both"), separate=True)
    merged = pixels(split.groupBy("id", "px", "py").agg(F.max("value").alias("value")))
    assert merged == pixels(dotplot(pairs, ["id"], PlotConfig(window=6, strand="both")))


def test_main_diagonal_and_dark(spark):
    pairs = spark.createDataFrame([(1, "ACGT" * 10, "ACGT" * 10), (2, "A" * 10 + "C" * 10, "G" * 10 + "T" * 10)], "id long, query string, subject string")
    got = dotplot(pairs.where("id = 1"), ["id"], PlotConfig(window=8, factor=80))
    assert sum(v == 255 for (x, y), v in pixels(got).items() if x == y) > 20
    assert not pixels(dotplot(pairs.where("id = 2"), ["id"], PlotConfig(window=5, factor=50)))


def test_translated_plot(spark):
    q, s = "ATGAAACTGATG" * 5, "MKLM" * 5
    pairs = spark.createDataFrame([(1, q, s)], "id long, query string, subject string")
    got = pixels(translated_dotplot(pairs, ["id"], PlotConfig(window=5, factor=80, scoring=blosum62().scoring())))
    assert max(x for x, _ in got) < 20 and sum(x == y for x, y in got) > 5


def test_plot_errors():
    with pytest.raises(PlotError):
        PlotConfig(zoom=0).check()
    with pytest.raises(PlotError):
        PlotConfig(strand="reverse", scoring=blosum62().scoring()).check()
    PlotConfig(memory_limit=100).check_size(10, 10)
    for limit, separate in ((99, False), (199, True)):
        with pytest.raises(PlotError):
            PlotConfig(memory_limit=limit, strand="both").check_size(10, 10, separate)


def test_zoom(spark):
    for q, s, target, want in ((27000, 27000, 4096, 7), (1000, 100000, 4096, 25)):
        assert one(spark, scores.auto_zoom(F.lit(q), F.lit(s), target)) == (want,)
    for base, period, tol, want in ((11, 451, 2.0, 11), (22, 451, 2.0, 41), (20, 450, 2.0, 25), (22, 451, 1.1, 22), (9, 1, 2.0, 9)):
        assert one(spark, scores.snap_zoom(F.lit(base), F.lit(period), tol)) == (want,)
    assert one(spark, scores.gcd(F.lit(450), F.lit(900)), scores.gcd(F.lit(0), F.lit(7))) == (450, 7)


def test_scalars(spark):
    assert one(spark, *(scores.ramp(F.lit(p)) for p in (0, 40, 41, 70, 100, 255))) == (0, 0, 4, 127, 255, 255)
    assert one(spark, sequence.translate_codon(F.lit("ATG")), sequence.translate_codon(F.lit("UAA")), sequence.translate_codon(F.lit("ANG"))) == ("M", "*", "X")
    assert one(spark, sequence.translate_frame(F.lit("ATGAA"), 0), sequence.translate_frame(F.lit("AT"), 0), sequence.translate_frame(F.lit("ATG"), 3)) == ("M", "", "")
    assert one(spark, sequence.reverse_complement(F.lit("acgtnX"))) == ("NNACGT",)
    assert one(spark, sequence.detect_alphabet(F.lit("")), sequence.detect_alphabet(F.lit("ACGTU")), sequence.detect_alphabet(F.lit("MKLV"))) == ("Unknown", "Dna", "Protein")
    assert one(spark, sequence.encode_string(F.lit("aCx"), "ACGT")) == ([0, 1, None],)
    assert one(spark, labels.format_kb(F.lit(1234567)), labels.format_kb(F.lit(12345)), labels.format_kb(F.lit(1234)), labels.format_kb(F.lit(7))) == ("1.2M", "12k", "1.2k", "7")
    assert one(spark, labels.iso_utc(F.lit(0))) == ("1970-01-01T00:00:00Z",)
    assert one(spark, labels.sha256(F.lit("abc")))[0].startswith("ba7816bf")
    assert one(spark, labels.coordinate(F.lit("r"), F.lit(0), F.lit(2)), labels.wrap(F.lit("ABCDE"), 2)) == ("r:1", "AB\nCD\nE")
    assert one(spark, scores.greyramp(F.lit(50), 40, 60), scores.greyramp(F.lit(10), 40, 60), scores.greyramp(F.lit(99), 40, 60, True)) == (128, 255, 255)
    assert one(spark, sequence.match_line(F.lit("AC"), F.lit("AG"))) == ("| ",)


def test_matrices():
    m = blosum62()
    assert (m.lowest(), m.highest()) == (-4, 11)
    assert all(m.rows[i][j] == m.rows[j][i] for i in range(24) for j in range(24))
    assert parse_matrix(m.to_text(), "BLOSUM62") == m
    assert parse_matrix("   A C G T N\n" + "\n".join(f"{c} " + " ".join("5" if c == x else "-4" for x in "ACGTN") for c in "TGCAN"), "d", "ACGT", "N").rows == dna_identity().rows
    for text in ("", "  A C\nA 1 -1", "  A ?\nA 1 1", "  A\nA 1 2"):
        with pytest.raises(ValueError):
            parse_matrix(text, "x", "AC")
    with pytest.raises(ValueError):
        custom_dna(5, 4).validate()


def test_blosum62_cells():
    """Ambiguity letters of the public table."""
    m, at = blosum62(), sequence.PROTEIN.index
    for pair, want in (("AX", 0), ("NB", 3), ("DB", 4), ("QZ", 3), ("EZ", 4), ("GX", -1), ("SX", 0), ("TX", 0), ("CX", -2), ("PX", -2), ("WX", -2), ("XX", -1), ("BZ", 1), ("BB", 4), ("ZZ", 4), ("**", 1), ("W*", -4), ("AB", -2), ("SB", 0), ("KZ", 1), ("YZ", -2)):
        assert m.rows[at(pair[0])][at(pair[1])] == m.rows[at(pair[1])][at(pair[0])] == want, pair


def test_matrices_by_name(tmp_path):
    (tmp_path / "PAM30").write_text(blosum62().to_text())
    assert by_name("blosum62") == blosum62() and by_name("pam30", str(tmp_path)).name == "PAM30"
    for name, folder in (("BLOSUM45", None), ("nothing", str(tmp_path))):
        with pytest.raises(ValueError):
            by_name(name, folder)


def test_karlin_of_sequences(spark):
    """Statistics from the letters of two sequences, as columns."""
    cases = [
        ("ACGTACGTACGTACGTACGT" * 40, "GTGTACGAGCATCGTCTACT" * 40, 0.19152927398681641, 0.17334580950735284, 0.35672379416682848, 1.8625027221237367, 38.938557203279061, 21),
        ("AAAACCCGGGTTTAACAGCTAGCTACGATCGATCGATCGTAGCTAGCTAGCT", "TTTTGGGCCCAATTGCTAGCTACGATCGATCGATCGTAGCTAGCTAGCTACG", 0.19408679008483887, 0.17628106821340828, 0.36590167746510743, 1.8852477147216717, 38.5119708014956, 20),
        ("ACGT" * 10, "ACGT" * 10, 0.19152927398681641, 0.17334580950735284, 0.35672379416682848, 1.8625027221237369, 38.938557203279061, 21),
    ]
    rows = [(i, q, s) for i, (q, s, *_) in enumerate(cases)] + [(8, "AAAA", "AAAA"), (9, "NNN", ""), (10, None, "ACGT")]
    df = spark.createDataFrame(rows, "id long, q string, s string")
    freqs = df.select("id", *(karlin.residue_frequencies(F.col(c), "ACGT").alias(f"f{c}") for c in "qs"))
    out = {r["id"]: r for r in karlin.karlin_statistics(freqs, ["id"], [list(r) for r in dna_identity().rows]).collect()}
    for i, (*_, lam, k, h, res, msp, window) in enumerate(cases):
        r = out[i]
        assert r["window"] == r["predicted"] == window
        for got, want in ((r["lambda"], lam), (r["k"], k), (r["h"], h), (r["expected_residue"], res), (r["expected_msp"], msp)):
            assert abs(got - want) < 1e-6 * abs(want)
    assert all(out[i]["window"] is None for i in (8, 9, 10))
    hist = {r["score"]: r["p"] for r in karlin.score_histogram(freqs.where("id = 2"), ["id"], dna_identity().frame(spark).drop("matrix")).collect()}
    assert abs(hist[5] - 0.25) < 1e-12 and abs(hist[-4] - 0.75) < 1e-12


def test_automatic_plots_and_refusals(spark):
    q = "ACGTACGTACGTACGTACGT" * 10
    df = spark.createDataFrame([(1, q, q[::-1]), (2, "AAAA" * 9, "AAAA" * 9)], "id long, query string, subject string")
    auto = pixels(dotplot(df.where("id = 1"), ["id"], PlotConfig(window=None, factor=0)))
    assert auto and auto == pixels(dotplot(df.where("id = 1"), ["id"], PlotConfig(window=21, factor=27)))
    assert dotplot(df.where("id = 2"), ["id"], PlotConfig(window=None)).count() == 0
    with pytest.raises(PlotError):
        dotplot(df, ["id"], PlotConfig(window=None, plan="relational"))
    for cfg in (PlotConfig(memory_limit=200 * 200 - 1), PlotConfig(memory_limit=2 * 200 * 200 - 1, strand="both")):
        with pytest.raises(Exception, match="beyond the limit"):
            dotplot(df, ["id"], cfg, separate=True).count()
    assert dotplot(df.where("id = 1"), ["id"], PlotConfig(memory_limit=200 * 200)).count() > 0
    with pytest.raises(Exception, match="equal length"):
        dotplot(df.withColumn("query", F.concat("query", F.lit("A"))), ["id"], PlotConfig(self_plot=True)).count()
    with pytest.raises(Exception, match="three letters"):
        translated_dotplot(df.withColumn("query", F.lit("AC")), ["id"], PlotConfig(scoring=blosum62().scoring())).count()
    with pytest.raises(PlotError):
        translated_dotplot(df, ["id"], PlotConfig())
    lower = pixels(dotplot(df.select("id", "query", F.col("query").alias("subject")).where("id = 1"), ["id"], PlotConfig(self_plot=True, disable_mirror=True)))
    assert all(x <= y for x, y in lower)


@pytest.mark.parametrize("strand", ["forward", "reverse"])
@pytest.mark.parametrize("zoom", [1, 3])
def test_bands_do_not_change_plots(spark, strand, zoom, monkeypatch):
    rng = random.Random(zoom)
    letters = lambda n, more="": "".join(rng.choices("ACGT" + more, k=n))
    q = letters(150)
    df = spark.createDataFrame([(1, q, q[20:90] + letters(61)), (2, letters(40, "N"), letters(90)), (3, q, q)], "id long, query string, subject string")
    monkeypatch.setattr(kernel, "_BAND", 1500)
    for self_plot in (False, True):
        rows = df.where("id = 3") if self_plot else df
        plot = lambda cells: sorted(tuple(r) for r in kernel.block_dotplot(rows, ["id"], "query", "subject", kernel.Scoring(), 8, zoom, 12, strand == "reverse", self_plot, cells).collect())  # noqa: B023, E731
        assert plot(1 << 30) == plot(2000) != []
        hits = kernel.relational_hits(rows, ["id"], "query", "subject", kernel.Scoring(), 8, strand == "reverse", self_plot)
        sizes = rows.select("id", F.length("query").alias("qlen"), F.length("subject").alias("slen"))
        assert plot(2000) == sorted(tuple(r) for r in kernel.lit_pixels(hits, sizes, ["id"], 8, zoom, 12, strand == "reverse").collect())


def test_offset_parts_do_not_change_sums(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT" if i % 2 else "ACGTN", k=30 * i))) for i in range(7)], "id long, seq string").withColumn("x", F.col("id") * 2)
    rows = lambda cells: sorted(tuple(r) for r in periodogram.periodogram(df, "id", "seq", keep=["x"], part_cells=cells).collect())
    assert rows(1 << 30) == rows(100) and all(r[-1] == 2 * r[0] for r in rows(100))


UNIFORM = {5: 0.25, -4: 0.75}


def test_karlin_expected_score_of_zero(spark):
    """9 * matches = 4 * cells: the expected score is zero, and rounding made it negative with a lambda of zero."""
    a, b = "A" * 6 + "G" * 2 + "T", "A" * 9 + "C" * 3 + "G" * 3
    df = spark.createDataFrame([(1, a, b), (2, "ACGT" * 20, "ACGT" * 20)], "id int, query string, subject string")
    freqs = df.select("id", karlin.residue_frequencies(F.col("query"), "ACGT").alias("fq"), karlin.residue_frequencies(F.col("subject"), "ACGT").alias("fs"))
    out = {r["id"]: r["window"] for r in karlin.karlin_statistics(freqs, ["id"], [list(r) for r in dna_identity().rows]).collect()}
    assert out[1] is None and out[2] >= 3
    assert {r["id"] for r in dotplot(df, ["id"], PlotConfig(window=None, factor=0)).collect()} == {2}
    # A lambda of 1e-7 predicts a length beyond 32 bits.
    same = 4 / 9 - 1e-7
    near = spark.createDataFrame([(1, [same, 1 - same], [1.0, 0.0])], "id int, fq array<double>, fs array<double>")
    row = karlin.karlin_statistics(near, ["id"], [[5, -4], [-4, 5]]).first()
    assert row["lambda"] > 0 and abs(row["predicted"]) == 2**31 - 1


def test_karlin_golden(spark):
    k = karlin.karlin(UNIFORM)
    assert k.lam == 0.19152927398681641 and k.window == 21
    for got, want in ((k.k, 0.17334580950735284), (k.h, 0.35672379416682848), (k.expected_residue, 1.8625027221237367), (k.expected_msp, 38.938557203279061)):
        assert abs(got - want) < 1e-9
    assert one(spark, karlin.match_lambda(F.lit(0.25))) == (k.lam,)
    assert karlin.auto_pixel_factor(k.expected_residue) == 27
    for bad in ({5: 1.0}, {5: 0.9, -4: 0.1}, {-4: 1.0}):
        with pytest.raises(ValueError):
            karlin.karlin(bad)


def test_periodograms(spark):
    cfg = periodogram.PeriodogramConfig(window=7, factor=50, min_offset=3, max_offset=80, white=0, black=255)
    seq = ("ACGTACA" * 40)[:210]
    df = spark.createDataFrame([(1, seq), (2, "ACGTNACGTTGCA" * 6), (3, ""), (4, None)], "id long, seq string")
    block = {(r["id"], r["k"]): (r["raw_sum"], r["signal_sum"], r["n_pairs"]) for r in periodogram.periodogram(df, "id", "seq", cfg).collect()}
    assert max(range(3, 81), key=lambda k: block[1, k][0]) == 7
    assert block[1, 10][2] == 210 - 7 - 10
    rel = {(r["id"], r["k"]): (r["raw_sum"], r["signal_sum"], r["n_pairs"]) for r in periodogram.periodogram_relational(df.where("id < 3"), "id", "seq", cfg).collect()}
    assert rel == {k: v for k, v in block.items() if k[0] < 3}
    null = one(spark, periodogram.analytical_null(*(F.lit(10),) * 4))[0]
    assert (null["mean"], null["variance"]) == (-1.75, 15.1875)
    assert [periodogram.next_power_of_two(n) for n in (0, 1, 2, 3, 255, 256, 257)] == [1, 1, 2, 4, 256, 256, 512]
    assert periodogram.z_mode("auto", 0, 255) == "analytical" and periodogram.z_mode("auto", 40, 100) == "empirical"
    z = shuffles.shuffle_null(df.where("id = 1"), "id", "seq", cfg, 5, 42).collect()
    assert max(z, key=lambda r: r["z_score"])["k"] % 7 == 0


def test_shuffle_is_a_permutation():
    codes = np.arange(50)
    a = codes[shuffles.permutation(50, 42)]
    b = codes[shuffles.permutation(50, 42)]
    assert sorted(a) == list(range(50)) and (a == b).all() and (a[shuffles.permutation(50, shuffles.ahead(42, 49))] != a).any()


def test_spectrum(spark):
    x = [1.0 if i % 7 == 0 else 0.0 for i in range(256)]
    df = spectrum.spectrum(spark.createDataFrame([("a", x), ("b", [])], "key string, v array<double>"), "key", "v")
    top = spectrum.rank_peaks(df.where("key = 'a'"), "key", 6).collect()
    assert any(abs(r["period"] - 7) < 0.5 for r in top)
    n = np.arange(256)
    want = np.abs(np.fft.rfft((np.array(x) - np.mean(x)) * np.hanning(256)))
    assert np.allclose(spectrum.amplitudes(np.array(x))[0], want) and len(n) == 256


def spikes(n, at):
    x = np.zeros(n)
    for i, v in at.items():
        x[i] = v
    return x


def test_peaks():
    cfg = peaks.PeaksConfig(min_score=10, boundary_fraction=0.9)
    got = peaks.peaks_of_scores(spikes(300, {i: 100 for i in range(7, 200, 7)}), 0, cfg)
    base = [p for p in got if p.kind == "fundamental"]
    assert [p.period for p in base] == [7] and min(base[0].ladder) == 2
    got = peaks.peaks_of_scores(spikes(150, {i: 30 for i in range(7, 120, 7)} | {14: 120, 28: 120, 42: 100, 7: 25}), 0, peaks.PeaksConfig(min_score=5))
    assert {p.period for p in got if p.kind == "fundamental"} == {7}
    assert all(p.period <= 89 for p in peaks.peaks_of_scores(spikes(100, {95: 50, 20: 50, 40: 50}), 0, cfg))
    sub = peaks.PeaksConfig(min_score=100, min_harmonics=0, subrepeat_min_score=5)
    got = peaks.peaks_of_scores(spikes(400, {150: 200, 300: 180, 50: 30, 100: 25}), 0, sub)
    assert any(p.kind == "subrepeat" and p.period == 50 and p.parent == 150 and p.divisor == 3 for p in got)
    got = peaks.peaks_of_scores(spikes(200, {i: 100 for i in range(7, 100, 7)} | {i: 50 for i in range(12, 100, 12) if i % 7} | {60: 200}), 0, peaks.PeaksConfig(min_score=10, min_harmonics=0))
    assert next(p for p in got if p.period == 60).parent == 12
    assert peaks.peaks_of_scores(np.full(50, np.nan), 3) == []
    down = peaks.peaks_of_bins([(100.0, 50.0), (50.0, 30.0), (33.3, 20.0)])
    assert [(p.period, p.kind) for p in down] == [(100.0, "fundamental"), (50.0, "harmonic"), (33.3, "harmonic")]


def test_mad(spark):
    df = spark.range(1000).selectExpr("1 AS id", "cast(id % 11 AS double) AS score")
    r = peaks.mad_threshold(df, ["id"], "score", 5.0, 1.0).first()
    assert (r["median"], r["mad"]) == (5.0, 3.0) and abs(r["threshold"] - 27.239) < 1e-9


def test_ridges(spark):
    df = spark.createDataFrame([(1, i, i, 200) for i in range(3, 16)], "id long, px long, py long, value long")
    got = [tuple(r) for r in ridges.ridges(df, ["id"], 40, 5, 0).where("direction = 'forward'").collect()]
    assert got == [(1, "forward", 3, 3, 15, 15, 13, 200)]
    gap = df.where("px not in (7, 8)")
    assert ridges.ridges(gap, ["id"], 40, 5, 1).where("direction = 'forward'").count() == 1  # 3-6 is too short
    assert ridges.ridges(gap, ["id"], 40, 11, 2).count() == 1


def test_fasta(spark, tmp_path):
    text = b">a first\nacg t\nAC\n>b\nGG\n"
    want = [(0, "a", "first", "ACGTAC"), (1, "b", None, "GG")]
    assert fasta.parse_fasta(text) == fasta.parse_fasta(gzip.compress(text)) == want and fasta.parse_fasta(b"") == []
    for bad in (b"ACGT\n>a\nA", b">a\n>b\nC"):
        with pytest.raises(fasta.FastaError):
            fasta.parse_fasta(bad)
    (tmp_path / "x.fa").write_bytes(text)
    assert [tuple(r)[1:] for r in fasta.read_fasta(spark, str(tmp_path)).orderBy("record_idx").collect()] == want
    assert [tuple(r) for r in one(spark, fasta.split_records(F.lit(text.decode())))[0]] == want


def test_tsv_rows_do_not_depend_on_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\nx\ty\n1\t2\n\n3\n4\t5\t6\n7\t\n# more\n")
    df = tables.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert df.count() == df.select("x").count() == len(df.collect()) == 2
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("7", "")]


def test_fasta_headers_split_at_white_space(spark):
    assert [r[1:3] for r in fasta.parse_fasta(b">id\tdesc with space\nAC\n>b  c d\nAC\n>e\nAC\n")] == [("id", "desc with space"), ("b", "c d"), ("e", None)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("r", k, 10 * k, k, 0.1953125, float("nan")) for k in (3, 4, 5)], "record_id string, k long, raw_sum long, signal_sum long, signal_mean double, z_score double")
    tables.write_tsv(tables.periodogram_fields(df), str(tmp_path / "t"))
    back = tables.read_tsv(spark, str(tmp_path / "t"))
    assert tables.sniff(back.columns) == "periodogram" and back.count() == 3
    assert back.orderBy("k").first()["signal_mean"] == "0.195312" and back.first()["z_score"] == "NaN"
    assert tables.check_dense(df, "record_id", "k").count() == 3
    with pytest.raises(Exception, match="gap before"):
        tables.check_dense(df.where("k <> 4"), "record_id", "k").collect()
    with pytest.raises(ValueError):
        tables.sniff(["a"])


def test_fixed_point_texts_round_the_exact_value(spark):
    rng = random.Random(4)
    values = [s / n for n in (128, 640, 3200, 16000) for s in range(-2000, 2000)] + [m / 10**7 for m in range(5, 40_000, 10)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4, 6):
        wrong = [tuple(r) for r in df.select("v", tables.fixed("v", digits).alias("t")).collect() if r["t"] != f"{r['v']:.{digits}f}"]
        assert wrong == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in odd.coalesce(1).select(tables.fixed("v", 4)).collect()] == [None, "NaN", "Infinity", "-Infinity"]


def test_images(spark):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    back, notes = images.read_png(images.png(image, text={"Software": "test"}))
    assert (back == image).all() and notes == {"Software": "test"} and (images.read_png(images.png(image, invert=True))[0] == 255 - image).all()
    dot = images.read_dot(images.DotFile(2.5, image, 12, 8, "DNA", np.eye(4, dtype=np.int32)).to_bytes())
    assert (dot.image == image).all() and (dot.zoom, dot.window, dot.matrix_name) == (2.5, 8, "DNA") and dot.matrix[:4, :4].sum() == 4
    with pytest.raises(images.SizeError):
        images.read_dot(images.DotFile(1, image).to_bytes()[:-1])
    px = spark.createDataFrame([(1, 2, 9)], "px long, py long, value long")
    assert images.densify(px, 4, 3)[2, 1] == 9
    with pytest.raises(images.SizeError):
        images.densify(px, 1000, 1000, 10)
    assert "<svg" in images.svg(image, "a<b", "c") and "a&lt;b" in images.svg(image, "a<b", "c")
    assert images.params_toml({"plot": {"zoom": 1, "name": 'a"b'}}) == '[plot]\nzoom = 1\nname = "a\\"b"\n'


def test_stream(spark, tmp_path):
    from strandlace.streaming import incremental_periodogram

    rows = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGT"), (1, "ACGTACGTACGTACGTACGT"), (2, "AACCAACCAACCAACCAACC")], "id long, seq string")
    rows.write.parquet(str(tmp_path / "in"))
    cfg = periodogram.PeriodogramConfig(window=3)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = incremental_periodogram(stream, "id", "seq", str(tmp_path / "out"), str(tmp_path / "ck"), cfg).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, periodogram.periodogram(rows.dropDuplicates(["id"]), "id", "seq", cfg).collect()))


def test_render_fidelity(spark):
    pairs = spark.createDataFrame([(1, "ACGT" * 60, "ACGT" * 60)], "id long, query string, subject string")
    lit = dotplot(pairs, ["id"], PlotConfig(window=4, factor=40, scoring=Scoring()))
    bright = lit.where("value >= 128")
    assert ridges.dark_runs(bright, ["id"], 1).count() == 0
    sizes = spark.createDataFrame([(1, 240, 240)], "id long, width long, height long")
    assert ridges.dark_runs(ridges.resize_nearest(bright, sizes, ["id"], 360), ["id"], 1).count() > 0


def test_record_tiles(spark):
    """Against a direct maximum over each tile's cells; equal records give equal tiles, empty ones a cell."""
    rng, sizes, zoom = random.Random(8), [7, 7, 0, 1, 2500, 3], 3
    spans, at = [], 0
    for n in sizes:
        spans.append((1, at, at + n))
        at += n
    lit = {(rng.randrange(at), rng.randrange(at)): rng.randint(1, 255) for _ in range(400)}
    lit |= {(2, 9): 200, (9, 2): 199, (at + 5, 1): 250}
    axis, starts = spark.createDataFrame(spans, "plot long, start long, stop long"), []
    for n in sizes:
        starts.append(sum(max(1, -(-m // zoom)) for m in sizes[: len(starts)]))

    def place(p):
        return next((starts[i] + (p - s) // zoom for i, (_, s, e) in enumerate(spans) if s <= p < e), None)

    want = {}
    for (x, y), v in lit.items():
        if place(x) is not None and place(y) is not None:
            cell = (place(x), place(y))
            want[cell] = max(v, want.get(cell, 0))
    pixels = spark.createDataFrame([(1, x, y, v) for (x, y), v in lit.items()], "plot long, px long, py long, value long")
    out = tiles.record_tiles(pixels, axis, axis, ["plot"], zoom)
    assert {(r["px"], r["py"]): r["value"] for r in out.collect()} == want
    laid = tiles.record_axis(axis, ["plot"], zoom).orderBy("start", "stop").collect()
    assert [(r["offset"], r["cells"]) for r in laid] == list(zip(starts, [max(1, -(-n // zoom)) for n in sizes], strict=True))


def test_sessions(spark, tmp_path):
    plot = {"mode": "blastn", "matrix_name": "DNA", "window_size": 9, "zoom": 4, "pixel_fac": 30, "strand": "both", "self_comparison": False, "triangle": "both", "memory_limit_mib": 2}
    view = {"offset_x": 0.5, "offset_y": -2.0, "display_zoom": 1.5, "crosshair": [10, 3], "light_theme": True, "align_dock_visible": False, "align_window_size": 60}
    session = sessions.Session(plot, {"white": 40, "black": 100, "swap": False}, view, 'a "b"\\c\n.fa')
    text = sessions.session_toml(session)
    assert sessions.parse_session(text) == session and session.subject is None
    (tmp_path / "s.toml").write_text(text)
    assert sessions.read_session(spark, f"file://{tmp_path}/s.toml") == session
    cfg = sessions.plot_config(session)
    assert (cfg.window, cfg.zoom, cfg.factor, cfg.strand, cfg.memory_limit) == (9, 4, 30, "both", 2 << 20)
    old = "".join(x for x in text.splitlines(True) if "align_" not in x).replace("version = 2", "version = 1")
    assert sessions.parse_session(old).view == view | {"crosshair": [42, 14], "align_dock_visible": True, "align_window_size": 100}
    for bad in (text.replace("version = 2", "version = 3"), text.replace("zoom = 4\n", ""), "x = ["):
        with pytest.raises(sessions.SessionError):
            sessions.parse_session(bad)


def test_clipboard_text(spark):
    """Both strands around a crosshair, a positive pair, a place outside, ends that lie outside."""
    text = one(spark, sequence.clipboard_text(F.lit("ACGT"), F.lit("ACTT"), F.lit(1).cast("long"), F.lit(1).cast("long"), 5, Scoring(), True))[0]
    assert text == (
        "q = 2   s = 2   window = 5\n\n+/+\n"
        "query    5'        0 -ACGT 4        3'\n                     || |\nsubject  5'        0 -ACTT 4        3'\n"
        "\n+/-\n"
        "query    5'        0 -ACGT 4        3'\n                     |   \nsubject  5'        4 AAGT- 0        3'\n"
    )
    protein = one(spark, sequence.clipboard_text(F.lit("AK"), F.lit("SR"), F.lit(0).cast("long"), F.lit(0).cast("long"), 2, blosum62().scoring()))[0]
    assert protein.splitlines()[4] == " " * 20 + " :"


def test_utc_text_in_any_session(spark):
    from strandlace.session import options

    want = ["1969-12-31T23:59:59Z", "1970-01-01T00:00:00Z", "2024-02-29T12:34:56Z"]
    for zone in ("UTC", "Asia/Tokyo", "America/St_Johns"):
        with options(spark, **{"spark.sql.session.timeZone": zone}):
            got = spark.createDataFrame([(-1,), (0,), (1709210096,)], "s long").select(labels.iso_utc(F.col("s")).alias("t")).collect()
            assert [r["t"] for r in got] == want


def test_empty_axes_can_be_refused(spark):
    pairs = spark.createDataFrame([(1, "ACGT" * 9, "ACGT" * 9), (2, "", "ACGT" * 9), (3, None, "ACGT")], "id long, query string, subject string")
    assert {r["id"] for r in dotplot(pairs, ["id"]).collect()} == {1}
    for bad in (2, 3):
        with pytest.raises(Exception, match="letters on both axes"):
            dotplot(pairs.where(f"id = {bad}"), ["id"], PlotConfig(refuse_empty=True)).collect()
