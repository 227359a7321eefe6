"""The splittable FASTA reader against the parser of whole files."""

import gzip
import random

import pytest

from strandlace.session import options
from strandlace.sources.fasta import parse_fasta
from strandlace.sources.fasta_chunks import read_fasta_chunks, whole_records


def fasta(seed: int, records: int) -> str:
    """Lines of any length, blanks and tabs, blank lines, both line ends, long headers, letters beyond ASCII."""
    rng = random.Random(seed)
    out = []
    for i in range(records):
        end = rng.choice(["\n", "\r\n"])
        out.append(">" + rng.choice([f"r{i}", f"r{i} about {'x' * rng.randrange(300)}", f" r{i}\tmore  words ", ""]) + end)
        letters = "".join(rng.choices("ACGTacgtNn*-", k=rng.choice([1, 5, 80, 700, 9000]))) + ("é" * 3 if i % 9 == 0 else "")
        width = rng.choice([7, 60, 1000])
        for at in range(0, len(letters), width):
            out.append(letters[at : at + width] + rng.choice(["", "", " ", "\t"]) + end + (end if rng.random() < 0.05 else ""))
    return "".join(out)


def read(spark, path, block: int, chunk: int):
    with options(spark, **{"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"}):
        return read_fasta_chunks(spark, path, chunk).collect()


@pytest.mark.parametrize(("block", "chunk"), [(50, 64), (997, 333), (20_000, 5000), (1 << 27, 1 << 20)])
def test_equals_the_parser(spark, tmp_path, block, chunk):
    want = {}
    for i in range(3):
        text = ("\n\n" if i == 1 else "") + fasta(i, [40, 3, 12][i] if block > 60 else 4)
        (tmp_path / f"f{i}.fa").write_bytes(text.encode())
        want[f"f{i}.fa"] = parse_fasta(text.encode())
    got = {}
    for r in read(spark, str(tmp_path), block, chunk):
        assert len(r["letters"]) <= chunk
        got.setdefault(r["path"].rpartition("/")[2], {}).setdefault(r["record_idx"], []).append(r)
    for name, records in want.items():
        assert len(got[name]) == len(records)
        for idx, record_id, description, sequence in records:
            rows = sorted(got[name][idx], key=lambda r: (r["start"], r["letters"]))
            assert [r["record_id"] for r in rows if r["record_id"] is not None] == [record_id]
            assert [r["description"] for r in rows if r["description"] is not None] == ([description] if description is not None else [])
            at = 0
            for r in rows:
                assert r["start"] == at
                at += len(r["letters"])
            assert "".join(r["letters"] for r in rows) == sequence


def test_many_tasks_read_one_file(spark, tmp_path):
    """A record of 2 million letters, in blocks of 64 KiB: no task sees more than a block and a chunk."""
    rng = random.Random(1)
    sequence = "".join(rng.choices("ACGT", k=2_000_000))
    (tmp_path / "big.fa").write_text(">big one\n" + "\n".join(sequence[i : i + 60] for i in range(0, len(sequence), 60)) + "\n>next\nAC\n")
    with options(spark, **{"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1"}):
        chunks = read_fasta_chunks(spark, str(tmp_path), 50_000)
        assert chunks.rdd.getNumPartitions() > 20
        assert "BroadcastHashJoin" in chunks._jdf.queryExecution().executedPlan().toString()
        rows = {r["record_id"]: r["sequence"] for r in whole_records(chunks).collect()}
        assert rows == {"big": sequence, "next": "AC"}
        with pytest.raises(Exception, match="more letters"):
            whole_records(chunks, 1000).collect()


def test_gzip_and_nothing(spark, tmp_path):
    text = fasta(7, 9).encode()
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(text))
    (tmp_path / "empty.fa").write_text("")
    got = {r["record_idx"]: r["sequence"] for r in whole_records(read_fasta_chunks(spark, str(tmp_path), 100)).collect()}
    assert got == {i: s for i, _, _, s in parse_fasta(text)}
    only = tmp_path / "only"
    only.mkdir()
    (only / "empty.fa").write_text("\n \n")
    assert read_fasta_chunks(spark, str(only)).count() == 0


@pytest.mark.parametrize(("text", "says"), [("ACGT\n>a\nAC\n", "before the first header"), (">a\n>b\nAC\n", "without residues"), (">a\nAC\n>b\n \n", "without residues"), (">a\nAC\n>b\n" + "\n" * 200 + ">c\nAC\n", "without residues")])
@pytest.mark.parametrize("block", [10, 1 << 27])
def test_errors(spark, tmp_path, text, says, block):
    (tmp_path / "bad.fa").write_text(text)
    with pytest.raises(Exception, match=says):
        read(spark, str(tmp_path), block, 100)


def test_small_blocks_share_tasks(spark, tmp_path):
    from strandlace.sources import fasta_chunks

    text = "".join(f">r{i} d{i}\n{'ACGTN' * 12}\n{'GATTACA' * 3}\n" for i in range(900))
    (tmp_path / "a.fa").write_text(text)
    with options(spark, **{"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}):
        assert fasta_chunks._lines(spark, str(tmp_path)).rdd.getNumPartitions() <= max(fasta_chunks.MOST_TASKS, 4 * spark.sparkContext.defaultParallelism)
        found = fasta_chunks.whole_records(fasta_chunks.read_fasta_chunks(spark, str(tmp_path), 50)).collect()
    assert {(r["record_idx"], r["record_id"], r["description"], r["sequence"]) for r in found} == {(i, f"r{i}", f"d{i}", "ACGTN" * 12 + "GATTACA" * 3) for i in range(900)}


def test_records_of_split_files(spark, tmp_path):
    from strandlace.sources.fasta import read_fasta, read_fasta_records

    text = "".join(f">r{i}{f' d {i}' if i % 3 else ''}\n{'acgtn' * (i % 40 + 1)}\nGAT TACA\n" for i in range(300))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_bytes(b"> x  y z \r\nAC\r\n\r\nGT\r\n>\nTT")
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(text.encode()))
    names = ["path", "record_id", "description", "sequence"]
    with options(spark, **{"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}):
        out = read_fasta_records(spark, str(tmp_path))
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in out.select(*names).collect()]
    tail = lambda rows: sorted((r[0].rsplit("/", 1)[1], *(x or "" for x in r[1:])) for r in rows)
    assert tail(got) == tail(tuple(r) for r in read_fasta(spark, str(tmp_path)).select(*names).collect())
