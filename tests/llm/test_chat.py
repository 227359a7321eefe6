"""Chat formatting against a plain formatter, and exact round trips."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandlace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, chunk int, piece string, n_turns string"
ODD = ["</s>", "[INST] ok [/INST]", "<\\s>", "[\\\\/TURN]", "[INST", "<", "[[INST]]", "\\", "", None, " [/INST] ", "a\n[TURN] x\n[/TURN]</s", "é€😀</s>" * 3, "</" + "s>", "<<s>>\\"]


def turns_of(seed: int = 3) -> list[tuple]:
    """Odd texts and roles, null ids, turns and roles, repeated rows, one long and one many-turned conversation."""
    rng = random.Random(seed)
    rows = [(c, t, ["user", "assistant", "system", None, "to\nol\\n", "[INST]", ""][rng.randrange(7 if c % 3 else 2)], rng.choice(ODD) if rng.random() < 0.6 else "wörd " * rng.randrange(9)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b</s>"), (None, None, "assistant", "last"), (100, None, "user", "n"), (100, 3, "user", "m"), (100, 3, "assistant", "tie"), (100, 3, "assistant", "tie")]
    rows += [(101, 0, "user", "long"), (101, 1, "assistant", "xé</s>" * 200_000), (101, 2, "assistant", "end")]
    rows += [(102, t, "user" if t % 2 == 0 else "assistant", f"turn {t} [/INST]") for t in range(900)]
    return rows


def table(spark, rows):
    rng = random.Random(1)
    rows = rng.sample(rows, len(rows))
    return spark.createDataFrame([(*r, "f", 7, "p", "n") for r in rows], SCHEMA).repartition(5)


def ordered(rows: list[tuple]) -> dict:
    out: dict = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in out.items()}


def expected(rows: list[tuple]) -> dict:
    out = {}
    for c, turns in ordered(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(frame) -> dict:
    got = frame.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


@pytest.mark.parametrize("hot", [{}, {"piece_bytes": 300}, {"piece_bytes": 2000, "share": 4, "least": 20}, {"share": 2, "least": 1}])
def test_reads_back(spark, hot):
    rows = turns_of()
    chats = chat.format_chats(table(spark, rows), **hot)
    assert digests(chat.read_back(chats)) == expected(rows)
    got = chats.collect()
    whole = {r["conv_id"]: r for r in got if r["whole"]}
    if not hot:
        assert len(whole) == len(got) == len(expected(rows))
    else:
        assert len(got) > len(expected(rows))
    want = ordered(rows)
    for c, r in whole.items():
        assert chat.read_turns(r["formatted"]) == want[c] and r["n_turns"] == len(want[c])
        assert [chat.unescape(r["formatted"][s["begin"] : s["end"]]) for s in r["loss"]] == [x for role, x in want[c] if role == "assistant"]


def test_plain_form(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "tool", "x")]
    row = chat.format_chats(table(spark, rows)).first()
    assert row["formatted"] == "[INST] hi [/INST]yo</s>[TURN] tool\nx [/TURN]"
    assert [(s["begin"], s["end"]) for s in row["loss"]] == [(17, 19)]


def test_texts_cannot_break_the_template(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    text = chat.format_chats(table(spark, rows)).first()["formatted"]
    assert text.count("</s>") == 1 and text.count("[INST]") == 1 and text.count("[/INST]") == 1
    rng = random.Random(9)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "TURN]", "x", " "]) for _ in range(rng.randrange(12)))
        e = chat.escape(pa.array([t]))[0].as_py()
        assert chat.unescape(e) == t and not any(c in e for c in ("</s>", "<s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]"))


def test_empty_table_and_a_text_of_megabytes(spark):
    assert chat.read_back(chat.format_chats(table(spark, turns_of()).where("false"))).count() == 0
    big = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.expr("repeat('é</s> ', 2000000)").alias("text"))
    row = chat.read_back(chat.format_chats(big)).first()
    text = "é</s> " * 2_000_000
    assert (row["loss_chars"], row["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())
