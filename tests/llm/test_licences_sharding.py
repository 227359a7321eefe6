"""Licence rules and rendezvous shards recomputed the plain way, and texts of megabytes."""

import random
import re
import time

import brute
import pytest
from strandlace.llm import licenses, secrets, sharding

SENTENCE = {ident: text for text, ident in reversed(licenses.SENTENCES.items())}


def scan(text: str, rules=licenses.RULES, gap: int = 2):
    look = licenses.reader(licenses.SENTENCES, True)
    probe = re.compile("|".join(licenses.hints(licenses.SENTENCES, True)).encode(), re.IGNORECASE).search
    return licenses.recognise(text.encode(), look, rules, gap, probe)


@pytest.mark.parametrize("seed", range(30))
def test_rules_equal_brute_force(seed):
    rng = random.Random(seed)
    names = sorted({n for _, wanted in licenses.RULES[:6] for n in wanted} & set(SENTENCE))
    chains = [wanted for _, wanted in licenses.RULES[:6]]
    idents: list = []
    while len(idents) < 60:
        idents += rng.choice([[None], [rng.choice(names)], list(rng.choice(chains)), [rng.choice(names)] * 3])
    gap = rng.choice([0, 1, 2, 5])
    text = "".join((SENTENCE[i] if i else f"unknown words number {k} about a license") + ".\n" for k, i in enumerate(idents))
    starts, at = [], 0
    for line in text.splitlines():
        starts.append((at, at + len(line)))
        at += len(line) + 1
    found, names_found, spans = scan(text, licenses.RULES, gap)
    assert found == [i for i in idents if i]
    want, places = brute.licence_rules(idents, licenses.RULES, gap)
    assert names_found == want
    assert [s[0] for s in spans] == [starts[a][0] for a, _ in places]


@pytest.mark.parametrize("stop", [".", ""])
def test_one_sentence_ten_megabytes(stop):
    """A rule's first sentence over and over, with the rest of the rule nowhere, or once at the end."""
    line = SENTENCE["bsd-grant"] + stop + "\n"
    began = time.time()
    found, names, _ = scan(line * (10_000_000 // len(line)))
    assert len(found) == 10_000_000 // len(line) and names == []
    found, names, _ = scan(line * (2_000_000 // len(line)) + SENTENCE["bsd-source"] + ".\n" + SENTENCE["bsd-binary"] + ".\n")
    assert names == ["BSD-2-Clause"]
    assert time.time() - began < 60


def test_shards_recomputed(spark):
    rows = [(i, f"text {i % 7} é") for i in range(-50, 450)] + [(None, "x"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.assign_shards(docs, dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == brute.rendezvous(key, 8) and r["grown_shard"] == brute.rendezvous(key, 9)
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_secrets_in_long_key_blocks(spark):
    """A key block of 6 KB and the head of a token over a megabyte: neither overflows the matcher's stack."""
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("A" * 64 for _ in range(95)) + "\n-----END RSA PRIVATE KEY-----\n"
    rows = [(1, block), (2, "eyJ" * 350_000), (3, "password = " + "z" * 1_000_000), (4, "é" * 1_000_000 + " token: abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert found[1]["spans"] and found[3]["n_assign"] == found[4]["n_assign"] == 1 and found[2]["n_assign"] == 0
