"""The three runs from FASTA files to tables, images and parameter files."""

import random
import tomllib
from xml.etree import ElementTree

import numpy as np
import pytest

from strandlace.operators.kernel import Scoring, resolve
from strandlace.operators.peaks import PeaksConfig, peaks_of_scores
from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums, settled
from strandlace.plans import verbs
from strandlace.plans.dotplot import PlotConfig, PlotError, dotplot
from strandlace.sources.images import read_png
from strandlace.sources.tables import read_profiles, read_tsv


def fasta(tmp_path, name, records):
    path = tmp_path / name
    path.write_text("".join(f">{n}\n{s}\n" for n, s in records))
    return str(path)


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


RECORDS = [("z", dna(30, 1) * 9), ("a", dna(200, 2)), ("m", dna(7, 3) * 40), ("m", dna(50, 4)), ("flat", "A" * 40)]


def lines_of(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_periodogram_run(spark, tmp_path):
    path, out = fasta(tmp_path, "in.fa", RECORDS), str(tmp_path / "out")
    told = verbs.run_periodogram(spark, path, out, fft_top=3, peaks=PeaksConfig())
    auto = PeriodogramConfig(window=None, factor=0)
    want = []
    for name, s in RECORDS:
        own = settled(auto.scoring.codes(s), auto)
        if own is None:
            assert name == "flat"  # one letter has no statistics
            continue
        found = resolve(*[auto.scoring.codes(s)] * 2, Scoring(), None, 0)
        assert (own.window, own.factor) == found
        want += [(name, str(k), str(r), str(t)) for k, r, t, _ in zip(*diagonal_sums(auto.scoring.codes(s), own), strict=True)]
    table = read_tsv(spark, f"{out}/periodogram")
    got = [(r["record_id"], r["k"], r["raw_sum"], r["signal_sum"]) for r in table.collect()]
    assert got == want  # in the order of the file, then by offset
    heads = [x for x in lines_of(spark, f"{out}/periodogram") if x.startswith("# record_id=")]
    assert [h.split()[1] for h in heads] == ["record_id=z", "record_id=a", "record_id=m", "record_id=m"]
    assert f"length={len(RECORDS[0][1])}" in heads[0] and "freq_A=" in heads[0] and "z=off" in heads[0]
    assert told["offsets"] == len(want) and {r["z_score"] for r in table.select("z_score").distinct().collect()} == {"NaN"}
    assert {r["record_id"] for r in read_tsv(spark, f"{out}/fft").where("peak_rank = '1'").collect()} >= {"z", "m"}
    peaks = read_tsv(spark, f"{out}/peaks").where("record_id = 'z' and kind = 'fundamental'").collect()
    assert "30" in {r["period_bp"] for r in peaks}
    params = tomllib.loads("\n".join(lines_of(spark, f"{out}/params")))
    assert params["input"]["records"] == 5 and params["input"]["residues"] == sum(len(s) for _, s in RECORDS) and params["output"]["offsets"] == len(want)
    again = verbs.run_periodogram(spark, path, out, fft_top=3, peaks=PeaksConfig())
    assert again == told and [(r["record_id"], r["k"], r["raw_sum"], r["signal_sum"]) for r in read_tsv(spark, f"{out}/periodogram").collect()] == want


@pytest.mark.parametrize(("z", "white", "black", "mode"), [("auto", 40, 100, "empirical"), ("auto", 0, 255, "analytical"), ("empirical", 0, 255, "empirical")])
def test_scores(spark, tmp_path, z, white, black, mode):
    out = str(tmp_path / "out")
    cfg = PeriodogramConfig(max_offset=20, white=white, black=black)
    verbs.run_periodogram(spark, fasta(tmp_path, "in.fa", RECORDS[:2]), out, cfg, z, shuffles=4, seed=3)
    assert tomllib.loads("\n".join(lines_of(spark, f"{out}/params")))["run"]["z"] == mode
    scores = [float(r["z_score"]) for r in read_tsv(spark, f"{out}/periodogram").collect()]
    assert len(scores) == 36 and np.isfinite(scores).all() and any(scores)


def test_find_peaks_run(spark, tmp_path):
    first, out = str(tmp_path / "first"), str(tmp_path / "out")
    verbs.run_periodogram(spark, fasta(tmp_path, "in.fa", [r for i, r in enumerate(RECORDS) if i != 3]), first, PeriodogramConfig(), fft_top=5)
    table = read_tsv(spark, f"{first}/periodogram").collect()
    cfg = PeaksConfig(min_score=2.0, min_harmonics=0, subrepeat_min_score=1.0)
    verbs.run_find_peaks(spark, f"{first}/periodogram", out, cfg, mads=1.5, harmonics=True)
    want, silent = {}, set()
    for name in ("z", "a", "m", "flat"):
        x = np.array([float(r["signal_mean"]) for r in table if r["record_id"] == name])
        mid = np.median(x)
        mad = np.median(abs(x - mid))
        floor = max(2.0, mid + mad * 1.5 * 1.4826) if mad > 0 else 2.0
        found = peaks_of_scores(x, 3, PeaksConfig(**{**cfg.__dict__, "min_score": floor}))
        want[name] = sorted((str(int(p.period)), p.kind) for p in found)
        if not found:
            silent.add(name)
    got: dict = {n: [] for n in want}
    for r in read_tsv(spark, f"{out}/peaks").collect():
        got[r["record_id"]].append((r["period_bp"], r["kind"]))
    assert {n: sorted(v) for n, v in got.items()} == want
    diag = {x.split()[2]: x for x in lines_of(spark, f"{out}/peaks") if x.startswith("# diag")}
    assert set(diag) == {f"record_id={n}" for n in want} and all("threshold_mode=mad floor=2.0" in x for x in diag.values())
    top = str(tmp_path / "top")
    verbs.run_find_peaks(spark, f"{first}/periodogram", top, cfg, top=1)
    assert read_tsv(spark, f"{top}/peaks").groupBy("record_id").count().where("count > 1").count() == 0
    spectra = str(tmp_path / "spectra")
    assert verbs.run_find_peaks(spark, f"{first}/fft", spectra, PeaksConfig(min_score=0.1, min_harmonics=0))["peaks"] > 0
    with pytest.raises(ValueError, match="sub-repeats"):
        verbs.run_find_peaks(spark, f"{first}/fft", spectra, cfg)


def test_batch_run(spark, tmp_path):
    out = str(tmp_path / "out")
    q, s = [("a", dna(90, 1)), ("b", dna(60, 2))], [("c", dna(30, 3) + dna(90, 1)[20:80])]
    told = verbs.run_batch(spark, fasta(tmp_path, "q.fa", q), fasta(tmp_path, "s.fa", s), out, PlotConfig(strand="both"))
    pair = spark.createDataFrame([(0, "".join(x for _, x in q), s[0][1])], "plot int, query string, subject string")
    want = {(r["px"], r["py"]): r["value"] for r in dotplot(pair, ["plot"], PlotConfig(strand="both")).collect()}
    image, notes = read_png(bytes(spark.read.parquet(f"{out}/image").first()["data"]))
    ys, xs = np.nonzero(image)
    assert {(int(x), int(y)): int(image[y, x]) for x, y in zip(xs, ys, strict=True)} == want
    assert image.shape == (told["height"], told["width"]) == (90, 150) and "mode=blastn" in notes["parameters"]
    drawing = ElementTree.fromstring(bytes(spark.read.parquet(f"{out}/svg").first()["data"]))
    names = [t.text for t in drawing.iter("{http://www.w3.org/2000/svg}text") if t.get("font-weight") == "bold"]
    assert names == ["a", "b", "c"] and drawing.get("width") == "230"
    # Against itself, with a zoom that divides the records' common length.
    own = fasta(tmp_path, "own.fa", [(str(i), dna(60, 7)) for i in range(9)])
    told = verbs.run_batch(spark, own, None, out, PlotConfig(), target=77)
    assert told["width"] == 540 // 10  # 8 pixels a base would fit; 10 divides 60
    # Protein letters switch the mode.
    protein = fasta(tmp_path, "p.fa", [("p", "MKWVLLAARNDCQEGHILKMFPSTWYV" * 2)])
    verbs.run_batch(spark, protein, None, out, PlotConfig(window=5, factor=20, strand="both"))
    assert tomllib.loads("\n".join(lines_of(spark, f"{out}/params")))["run"]["mode"] == "blastp"
    with pytest.raises(PlotError, match="limit"):
        verbs.run_batch(spark, own, None, out, PlotConfig(), memory=1000)
    with pytest.raises(PlotError, match="mode"):
        verbs.run_batch(spark, own, None, out, PlotConfig(), mode="other")


def test_tables_with_headers_of_their_own(spark, tmp_path):
    for name, text in (("x.tsv", "d\tH\tbg\n3\t1.5\t0.5\n5\t2\t0\n"), ("y y.tsv", "# about\nbg\td\tH\n0\t4\t7\n9\t9\n"), ("z.tsv", "d\tH\tbg\r\n3\t1\t2\r\n")):
        (tmp_path / name).write_text(text)
    rows = {tuple(r) for r in read_profiles(spark, str(tmp_path)).collect()}
    assert rows == {("x", 3, 1.5, 0.5), ("x", 5, 2.0, 0.0), ("y y", 4, 7.0, 0.0), ("z", 3, 1.0, 2.0)}
    (tmp_path / "w.tsv").write_text("d\tH\n1\t2\n")
    with pytest.raises(Exception, match="columns|cast|null"):
        assert read_profiles(spark, str(tmp_path)).where("bg is null").count() == 0, "null"
    (tmp_path / "v.tsv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="columns"):
        read_profiles(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.tsv").write_text("# only\n")
    with pytest.raises(ValueError, match="no header"):
        read_tsv(spark, str(tmp_path / "none"))


def test_peaks_are_found_once_for_all_outputs(spark, tmp_path, monkeypatch):
    from strandlace.operators.peaks import PeaksConfig
    from strandlace.plans import verbs

    rows = [(f"r{i}", f"r{i}", 3, [0.0, 9.0 * i, 0.0, 4.0, 0.0]) for i in range(4)]
    arrays = spark.createDataFrame(rows, "rec string, record_id string, base long, v array<double>")
    plans, text = [], verbs._text
    monkeypatch.setattr(verbs, "_text", lambda df, *a: plans.append(df._jdf.queryExecution().withCachedData().toString()) or text(df, *a))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert verbs._peaks(arrays, str(tmp_path / "p"), PeaksConfig(min_score=5.0, min_harmonics=0, boundary_fraction=1.0), None, None, True) == 3
    assert plans[0].count("InMemoryRelation") >= 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
