"""The two jobs: reruns, growing input, repeated batches, odd rows, the command line."""

import hashlib
import json
import logging
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, period_survey, queries, sequence_register
from strandlace.operators.periodogram import PeriodogramConfig, diagonal_sums
from strandlace.operators.kernel import Scoring
from strandlace.session import options
from verify import compare, duck

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, record string, k string, sha string, batch int"


def docs(spark, rows):
    """Documents with columns that clash with the jobs' own."""
    return spark.createDataFrame([(*r, "r", "k", "s", 9) for r in rows], DOCS)


def odd_rows(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = [(i, dna(rng.randrange(200)), rng.choice(["en", "de"])) for i in range(30)]
    rows += [(40, "ACGTT" * 40, "en"), (41, "xx acgtt " * 50, None), (42, None, "fr"), (43, "", "fr"), (44, "no", ""), (None, "GATTACA" * 20, "de"), (None, None, None)]
    rows += [(45, "TTAGGG" * 30, "en")] * 3 + [(46, "TTAGGG" * 30, "en"), (46, dna(90), "en")]
    return rows


def content(frame) -> list[str]:
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_survey_reruns_and_replaces(spark, tmp_path, caplog):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, odd_rows()).repartition(3).write.parquet(source)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    with caplog.at_level(logging.INFO, "jobs"):
        told = period_survey.run(spark, source, out)
    first = content(period_survey.output(spark, out))
    assert told["input"]["rows"] == len(odd_rows()) and told["output"]["rows"] == len(first)
    assert [m.split()[0] for m in caplog.messages] == ["read", "wrote"]
    again = period_survey.run(spark, source, out)
    assert content(period_survey.output(spark, out)) == first and again == told
    assert json.loads(spark.read.text(f"{out}/manifest").first()[0]) == json.loads(json.dumps(told))
    # A language that is gone leaves no partition behind.
    docs(spark, [r for r in odd_rows() if r[2] != "de"]).write.mode("overwrite").parquet(source)
    period_survey.run(spark, source, out)
    assert {r["lang"] for r in period_survey.output(spark, out).select("lang").distinct().collect()} == {"en", "fr", None}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_survey_finds_periods(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, odd_rows()).write.parquet(source)
    period_survey.run(spark, source, out)
    rows = period_survey.output(spark, out)
    best = {(r["record"], r["lang"]): r["k"] for r in rows.where("period_rank = 1").collect()}
    assert best[("40", "en")] == 5 and best[("41", None)] == 5 and best[("45", "en")] == 6 and best[(None, "de")] == 7
    counts = {(r["record"], r["length"]): r["n_rows"] for r in rows.select("record", "length", "n_rows").distinct().collect()}
    assert counts[("45", 180)] == 3 and counts[("46", 180)] == counts[("46", 90)] == 1 and counts[("42", 0)] == counts[("44", 0)] == 1
    assert rows.where("record = '42'").agg(F.sum("signal_mean")).first()[0] == 0
    codes = Scoring().codes("TTAGGG" * 30)
    k, _, signal, n = diagonal_sums(codes, PeriodogramConfig(max_offset=12))
    got = {r["k"]: r["signal_mean"] for r in rows.where("record = '45'").collect()}
    assert got == {int(a): round(b / c, 6) for a, b, c in zip(k, signal, n, strict=True)}


def test_survey_of_nothing_and_of_half_lengths(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, odd_rows()).where("false").write.parquet(source)
    assert period_survey.run(spark, source, out)["output"] == {"path": f"{out}/profiles", "rows": 0, "periods": 0}
    assert period_survey.output(spark, out).count() == 0
    docs(spark, [(1, "ACGTACCTGA" * 8, "en")]).write.mode("overwrite").parquet(source)
    period_survey.run(spark, source, out, max_offset=None)
    assert period_survey.output(spark, out).agg(F.max("k")).first()[0] == 40
    with pytest.raises(ValueError, match="output folder"):
        period_survey.run(spark, source, source)


def test_survey_of_fasta_files(spark, tmp_path):
    """FASTA records count as documents named by their record, without a language."""
    source, out, table = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "table")
    source.mkdir()
    rows = [r for r in odd_rows()[:30] if r[1]]
    (source / "a.fa").write_text("".join(f">{i} about\n{t[:50]}\n{t[50:]}\n" for i, t, _ in rows))
    told = period_survey.run(spark, str(source), out, format="fasta")
    docs(spark, [(i, t, None) for i, t, _ in rows]).write.parquet(table)
    period_survey.run(spark, table, str(tmp_path / "other"))
    assert content(period_survey.output(spark, out)) == content(period_survey.output(spark, str(tmp_path / "other"))) and told["input"]["rows"] == len(rows)


def test_settings_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"window": 5}')
    assert common.settings(spark, str(path), period_survey.DEFAULTS) == period_survey.DEFAULTS | {"window": 5}
    path.write_text('{"windows": 5}')
    with pytest.raises(ValueError, match="windows"):
        common.settings(spark, str(path), period_survey.DEFAULTS)
    for job in (period_survey, sequence_register):
        assert common.settings(spark, f"{ROOT}/jobs/{job.__name__.split('.')[1]}.json", job.DEFAULTS) == job.DEFAULTS


def expected_register(rows: list[tuple]) -> dict:
    out: dict = {}
    for i, text, _ in rows:
        seq = "".join(c for c in (text or "").upper() if c in "ACGT")
        n, least = out.get(seq, (0, None))
        out[seq] = (n + 1, i if least is None else least if i is None else min(i, least))
    return {hashlib.sha256(s.encode()).hexdigest(): (len(s), *v) for s, v in out.items()}


def registered(spark, out) -> dict:
    rows = sequence_register.output(spark, out)
    got = {r["sha"]: (r["length"], r["n_records"], r["first_id"]) for r in rows.select("sha", "length", "n_records", "first_id").distinct().collect()}
    assert rows.count() == 10 * len(got)
    return got


def test_register_follows_growing_input(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = odd_rows()
    docs(spark, rows[:20]).repartition(2).write.parquet(source)
    told = sequence_register.run(spark, source, out, buckets=4)
    assert told["records"] == 20 and registered(spark, out) == expected_register(rows[:20])
    assert sequence_register.run(spark, source, out, buckets=4)["batches"] == 0
    # The new files bring copies of known sequences and others.
    later = rows[20:] + [(500 + i, t, g) for i, t, g in rows[:5]] + [(-7, rows[3][1], "en")]
    docs(spark, later).repartition(2).write.mode("append").parquet(source)
    told = sequence_register.run(spark, source, out, buckets=4)
    known = expected_register(rows[:20])
    assert told["records"] == len(later) and told["new"] == len(set(expected_register(later)) - set(known))
    grown = registered(spark, out)
    assert grown == expected_register(rows + later[len(rows) - 20 :])
    # The same rows in one run from scratch.
    whole = str(tmp_path / "whole")
    sequence_register.run(spark, source, whole, buckets=4, files_per_batch=1)
    assert content(sequence_register.output(spark, whole)) == content(sequence_register.output(spark, out))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("register_")]


def test_a_batch_done_twice_counts_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = odd_rows()
    docs(spark, rows[:10]).write.parquet(source)
    cfg = sequence_register.DEFAULTS | {"buckets": 4}
    sequence_register.layout(spark, out, cfg)
    table = sequence_register.define(spark, out, 4)
    try:
        with options(spark, **{"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            for number, part in ((0, rows[:20]), (1, rows[10:]), (1, rows[10:])):
                sequence_register.take(docs(spark, part), number, table, cfg).write.mode("overwrite").insertInto(table)
        assert registered(spark, out) == expected_register(rows[:20] + rows[10:])
        # Known sequences come from the bucketed files without an exchange of their own.
        with options(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
            plan = sequence_register.take(docs(spark, rows), 2, table, cfg)._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = lambda line: m.end() if (m := re.match(r"[ :]*[+:]- ", line)) else 0
        at = next(i for i, line in enumerate(plan) if "register_" in line)
        assert "Bucketed: true" in plan[at]
        above = []
        for line in reversed(plan[:at]):
            if depth(line) < depth(above[-1] if above else plan[at]):
                above.append(line)
        joined = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above)
        assert joined > 0 and len(list((tmp_path / "out" / "register" / "batch=1").glob("*.parquet"))) <= 4
    finally:
        spark.sql(f"DROP TABLE {table}")


def test_register_refuses_other_settings(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, odd_rows()[:3]).write.parquet(source)
    sequence_register.run(spark, source, out, buckets=4)
    with pytest.raises(ValueError, match="another folder"):
        sequence_register.run(spark, source, out, buckets=8)


@pytest.mark.parametrize("job", ["period_survey", "sequence_register"])
def test_command_line(spark, tmp_path, job):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, odd_rows()[-6:]).write.parquet(source)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", source, out], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr
    assert {"period_survey": period_survey, "sequence_register": sequence_register}[job].output(spark, out).count() > 0


def test_letters_are_counted_once_for_each_record(spark, tmp_path):
    """The null model names each count dozens of times; the plan has each one once."""
    from jobs import period_survey
    from strandlace.plans.verbs import sequences

    (tmp_path / "a.fasta").write_text(">a\nACGTACGTAACC\n>b\nGGGTTTACAC\n")
    rows = spark.createDataFrame([("x", 1, "en", "a", "ACGTACGTAACCGGTA")], "record string, n_rows long, lang string, name string, seq string")
    for df in (period_survey.survey(rows, period_survey.DEFAULTS), sequences(spark, str(tmp_path / "a.fasta"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 4
