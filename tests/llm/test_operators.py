"""The training-data operators against brute force, on awkward small tables."""

import math
import random
import re
import textwrap
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from strandlace.llm import common, decontamination, licenses, line_dedup, packing, quality, scoring, secrets, sharding, simhash, substring_dedup
from strandlace.llm.common import join_hot
from strandlace.llm.components import components

SCHEMA = "doc_id long, text string, source string, key long, spans string, th string, word string, shard int"
PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed: int = 5) -> list[tuple]:
    """Near and exact copies, shared passages, runs of one word, long, empty and null texts, a null id."""
    rng = random.Random(seed)
    vocab = [a + b for a in ("ba", "ÉT", "ko", "zu", "Thé", "q") for b in ("", "ran", "li.", "mo,", "é")]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, lines = words(45), [" ".join(words(6)) for _ in range(5)]
    texts = [None, "", " \n\t ", "one", "a b c", "x " * 70, "y " * 25 + "end", ("p " * 19 + "q ") * 6]
    base = words(120)
    for i in range(14):
        copy = list(base)
        if i > 3:
            copy[rng.randrange(120)] = "edit"
        texts.append(" ".join(copy))
    for i in range(12):
        own = words(rng.randint(0, 60))
        texts.append(" ".join(own + passage[: 15 + 3 * i] + words(5)))
        texts.append("\n".join([" ".join(own[:5]), *lines, "", "", "", " ".join(own[5:9]), *lines[: i % 5]]))
    texts += ['password = "hunter2hunter2" token: abcdefgh', "API_KEY='AKIAABCDEFGHIJKL' secret=token: abcdefgh", "é" * 5 + "0123456789abcdef" * 3 + " AKIAX", "passwd:short PassWord:'" + "z" * 30]
    texts += ["Some text.\nReleased under the MIT License.\nMore.", " ".join(words(3000))]
    rows = [(i * 3 % 101, t, f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows.append((None, texts[9], "src0"))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "s", "t", "w", 2) for d, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def by_id(rows):
    return [(brute_id(d), t) for d, t, _ in rows]


def brute_id(d):
    return -(2**63) if d is None else d


def back(out):
    return sorted(((None if d == -(2**63) else d, *r) for d, *r in out), key=repr)


def test_secrets(docs, rows):
    want = sorted(((d, *brute.secrets(t)) for d, t, _ in rows), key=repr)
    assert got(secrets.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_secret_ledger_is_incremental(spark, docs):
    ledger, found = secrets.update_ledger(docs.where("doc_id < 50"))
    more, later = secrets.update_ledger(docs, ledger)
    known = {r["blob"] for r in ledger.select("blob").distinct().collect()}
    assert known and not known & {r["blob"] for r in more.collect()}
    both = found.unionByName(later)
    assert got(secrets.find_secrets(docs, findings=both), "doc_id", "spans") == got(secrets.find_secrets(docs), "doc_id", "spans")
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2) if r.kind == "hex" else r for r in secrets.RULES)
    again, _ = secrets.update_ledger(docs, ledger.unionByName(more), rules=newer)
    assert {(r["rule"], r["version"]) for r in again.collect()} == {("hex", 2)}


def test_secret_scan_runs_missing_pairs_only(spark, docs):
    ledger, found = secrets.update_ledger(docs)
    part = ledger.where("rule <> 'hex' and rule <> 'jwt'")
    new, later = secrets.update_ledger(docs, part)
    assert {r["rule"] for r in new.collect()} == {"hex", "jwt"}
    assert got(later, "blob", "rule", "start", "stop") == got(found.where("rule in ('hex', 'jwt')"), "blob", "rule", "start", "stop") != []
    none, nothing = secrets.update_ledger(docs, ledger)
    assert none.count() == nothing.count() == 0


def test_join_hot_deals_out_keys(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 9 + [3] + [None] * 30 + [4] * 10)], "k long, i long")
    right = rows.where("k is not null and k <> 4").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    for how, lost in (("inner", False), ("left", True)):
        out = join_hot(rows, right, "k", F.xxhash64("i"), 100, how, share=50, least=3)
        want = [(r["k"], r["i"], None if r["k"] in (None, 4) else r["k"] * 10) for r in rows.collect() if lost or r["k"] in (1, 2, 3)]
        assert out.columns == ["k", "i", "v"] and got(out, "k", "i", "v") == sorted(want, key=repr)


def test_simhash(docs, rows):
    want = sorted(brute.near_components([(d, t) for d, t, _ in rows]), key=repr)
    for limit, size in ((2048, 1 << 20), (3, 1 << 20), (2, 300)):
        out = simhash.near_groups(docs, shard_limit=limit, tree_bytes=size)
        assert got(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id"), "doc_id", "f", "component_id") == want


def test_bk_tree_finds_all_links():
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(12)]
    v = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for c in centre for _ in range(20)})
    tree = simhash.BKTree()
    for i, x in enumerate([*v, v[3]]):
        row, d = tree.add(x, i)
        assert (row < 0) == (i == 0) and (i == 0 or d == min(64, (v[row] ^ x).bit_count()))
    want = {(a, b) for a in v for b in v if a < b and (a ^ b).bit_count() <= 4}
    assert {(min(a, v[b]), max(a, v[b])) for a in v for b in tree.near(a, 4) if b < len(v) and a != v[b]} == want
    assert sorted(tree.near(v[3], 0)) == [3, len(v)]
    a = np.array([*v, v[5], v[5]], np.uint64)
    packed = simhash.PackedTree.grow(a)
    for t, rows in ((packed, packed.order), (simhash.PackedTree.unpack(packed.pack()), packed.order)):
        pairs = [(int(rows[n]), j) for n, hit in t.near(a, 4) for j in hit.tolist()]
        assert len(pairs) == len(set(pairs)) and {tuple(sorted((int(a[i]), int(a[j])))) for i, j in pairs if a[i] != a[j]} == want


def test_links_share_a_shard(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(63)
        y = x
        for b in rng.sample(range(63), rng.randint(0, 4)):
            y ^= 1 << b
        pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x long, y long")
    for taken in (2, 3, 4):
        keys = lambda c, taken=taken: F.array(*simhash.shard_keys(F.col(c), 4, taken))
        assert df.where(~F.arrays_overlap(keys("x"), keys("y"))).count() == 0
    assert [simhash.blocks_taken(4, n) for n in (0, 10**6, 10**9, 10**11)] == [2, 2, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, x) for x in range(101, 130)] + [(5, 5)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(out[i] == i // 10 * 10 for i in range(40) if i % 10) and all(out[x] == 100 for x in range(101, 130))
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def unique(rows):
    """Rows with ids of their own, so that plain dictionaries order them like the operators."""
    return [(i if d is not None else None, t, s) for i, (d, t, s) in enumerate(rows)]


def test_lines(spark, rows):
    rows = unique(rows)
    out = line_dedup.remove_repeated_lines(table(spark, rows))
    assert got(out, "doc_id", "n_lines", "n_removed", "kept_text") == back(brute.line_dedup(sorted((d, t or "") for d, t in by_id(rows))))


@pytest.mark.parametrize("window", [20, 8])
def test_substrings(spark, rows, window):
    rows = unique(rows)
    out = substring_dedup.remove_repeats(table(spark, rows), window=window)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == back(brute.substring_dedup(by_id(rows), window))


def test_substrings_random(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, " ".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 90))), None) for i in range(30)]
        rows += [(100 + i, " ".join(rng.choice(rows)[1].split()[rng.randint(0, 9) :]), None) for i in range(20)]
        out = substring_dedup.remove_repeats(table(spark, rows))
        assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == back(brute.substring_dedup(by_id(rows)))


def test_recompression_agrees_inside_equal_substrings():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 5, 200).astype(np.uint64)
    a, b = (np.concatenate((rng.integers(0, 5, n).astype(np.uint64), shared, rng.integers(0, 5, 9).astype(np.uint64))) for n in (17, 30))
    at = []
    for x, shift in ((a, 17), (b, 30)):
        offsets = np.array([0, len(x)])
        levels = list(substring_dedup.rounds(x, offsets))
        first, pick = substring_dedup.picks(levels[:3], offsets, 20)
        inside = (first >= shift) & (first + 20 <= shift + 200)
        begin, size = substring_dedup.blocks(levels[1:], len(x), 20)
        within = (begin >= shift) & (begin + size <= shift + 200)
        at.append((pick[inside] - shift, set(zip((begin[within] - shift).tolist(), size[within].tolist(), strict=True))))
    assert (at[0][0] == at[1][0]).all() and len(at[0][0]) == 181
    assert any(n >= 40 for _, n in at[0][1] & at[1][1])  # a long block names most of the repeat


def test_range_hashes_follow_content():
    h = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    key, twin = common.RangeHashes(h).of(np.array([0, 3, 4, 0]), np.array([3, 6, 7, 2]))
    assert key[0] == key[1] and twin[0] == twin[1] and len(set(key.tolist())) == len(set(twin.tolist())) == 3


@pytest.mark.parametrize("cut", [line_dedup.remove_repeated_lines, substring_dedup.remove_repeats])
def test_hot_rows_are_dealt_out(spark, cut, monkeypatch):
    """A third of all rows are one row without id, another third copies of one text."""
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(None, "null " + text, None)] * 400 + [(i, text, None) for i in range(400)] + [(1000 + i, " ".join(f"u{i}v{j}" for j in range(30)), None) for i in range(400)]
    df = table(spark, rows).repartition(16)
    monkeypatch.setattr(cut.__module__ + ".join_documents", lambda r, t, how="left": common.join_hot(r, t, ["did", "th"], F.monotonically_increasing_id(), r.count(), how, r.groupBy("did", "th").agg(F.count("*").alias("n")), least=20, share=50))
    out = got(cut(df), "doc_id", "n_removed")
    unit = 72 if cut is substring_dedup.remove_repeats else 6
    first = max(n for d, n in out if d is None)
    assert len(out) == 1200 and first == min(n for d, n in out if d is None) == 0
    lost = sorted({n for d, n in out if d is not None and d < 1000})
    assert lost and lost[-1] <= unit and lost[0] >= unit - 13
    assert not any(n for d, n in out if d is not None and d >= 1000)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, None), (1, text, None), (2, text, None), (1, "other " + text, None)]
    out = got(substring_dedup.remove_repeats(table(spark, rows)), "doc_id", "n_words", "n_removed")
    assert out.count((2, 40, 40)) == 1 and [r for r in out if r[1] == 40 and r[0] == 1][0] == [r for r in out if r[1] == 40 and r[0] == 1][1]


def test_quality(docs, rows):
    out = quality.judge(docs)
    want = sorted(((d, *brute.quality(t)) for d, t, _ in rows), key=repr)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("base_failed and kept").count() == 0
    assert got(out, "doc_id", "failed", "kept") == sorted(brute.judge(rows), key=repr)


def test_host_rules_decide(spark):
    """The host's record decides about documents that fail no base rule: trusted hosts keep them, rejected ones lose all."""
    prose = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    symbols = lambda i: prose(i) + " # $ % & * | < >"
    rows = [(i, symbols(i) if i == 7 else prose(i), "clean") for i in range(200)]
    rows += [(300 + i, symbols(i) if i % 4 == 0 else prose(i), "mixed") for i in range(100)]
    rows += [(500 + i, symbols(i) if i % 10 else prose(i), "junk") for i in range(60)]
    rows += [(600, symbols(1), None), (601, prose(1), None), (602, prose(2), "small"), (603, symbols(3), "small")]
    out = {r["doc_id"]: r for r in quality.judge(table(spark, rows)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert out[7]["kept"] and "symbols" in out[7]["host_trusted"].split(",")
    assert not out[300]["kept"] and out[301]["kept"] and not out[510]["kept"] and out[510]["host_rejected"] and not out[600]["kept"] and out[601]["kept"]
    assert sorted((d, r["failed"], r["kept"]) for d, r in out.items()) == sorted(brute.judge(rows))


def test_host_verdict(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", "junk") for i in range(30)] + [(100, good, "junk"), (101, good, "fine"), (102, "bad", "fine"), (103, good, None)] + [(200 + i, good, "fine") for i in range(5)]
    kept = {r["doc_id"] for r in quality.judge(table(spark, rows)).where("kept").collect()}
    assert kept == {101, 103, *range(200, 205)}
    shuffled = {r["doc_id"] for r in quality.judge(table(spark, rows), broadcast_hosts=0).where("kept").collect()}
    assert shuffled == kept


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "tiny item"), (3, None), (4, "..."), (5, "ÉTÉ " * 12), (None, "nul l"), (10, "x x x x x x x x x x x x"), (2, "second text of two")]


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_leaks(spark, rows, block):
    more = [(500, "so the quick, brown FOX jumps over the lazy dog again... and", None), (501, "the quick brown fox jumps not over the lazy dog again and again", None), (502, "a tiny item! nul l", None), (503, "x " * 30, None), (504, "ÉTÉ " * 11 + "tiny", None)]
    docs = table(spark, rows + more)
    out = decontamination.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_windows=block)
    out = out.withColumn("c", F.col("n_hit") > 0)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "c") == sorted(brute.leaks([(d, t) for d, t, _ in rows + more], ITEMS), key=repr)
    near = {r["doc_id"]: r["n_near"] for r in out.collect()}
    assert near[500] >= 1 and near[502] >= 2


def test_proximity_matches_name_their_items(spark):
    docs = table(spark, [(1, "alpha beta other gamma delta", None), (2, "alpha alone", None)])
    items = spark.createDataFrame([(7, "alpha beta gamma delta"), (8, "no such words")], "item_id long, text string")
    out = {r["doc_id"]: (r["n_near"], r["near_items"], r["items"]) for r in decontamination.find_leaks(docs, items).collect()}
    assert out == {1: (1, ["7"], []), 2: (0, [], [])}


def test_scores(spark, rows):
    out = {r["doc_id"]: r for r in scoring.score_documents(table(spark, unique(rows)), clustered=3, classes=2, table=15).collect()}
    for d, held, n, known, total, base in brute.base_scores([(d, t) for d, t, _ in unique(rows)]):
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    whole = {r["doc_id"]: r for r in scoring.score_documents(table(spark, unique(rows)), clustered=3, classes=2).collect()}
    assert all(abs(whole[d]["score"] - r["score"]) < 1e-6 for d, r in out.items())  # the table's size is a matter of speed


def test_class_scores_equal_brute_force(spark, rows):
    """Scores from the fitted classes alone, token by token; every context's probabilities add up to one."""
    rows = unique(rows)
    symbols = scoring.tokens(table(spark, rows))
    model = scoring.fit(symbols, clustered=3, classes=3, classed=8, classed_from=3, table=12)
    k, sym = 5, lambda w: xxhash.xxh64_intdigest(w.encode())
    cut = lambda t: [sym(w) for w in brute.WORD.findall((t or "").translate(brute.LOWER))] + [scoring.END]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = {}
    for d, t, _ in rows:
        for w in () if held(d) else cut(t):
            count[w] = count.get(w, 0) + 1
    context = {int(w): int(c) for w, c in zip(model.words, model.context, strict=True)}
    own = {int(w): int(c) for w, c in zip(model.words, model.own, strict=True)} | {r["word"] & (2**64 - 1): r["class"] for r in model.classes.collect()}
    assert context[scoring.END] == own[scoring.END] == 0
    assert sum(c < k - 1 for c in context.values()) <= 9 and all(count[w] >= 3 for w, c in own.items() if 0 < c < k - 1)
    assert any(w not in context for w in own) and len([w for w in own if 0 < own[w] < k - 1]) > 8  # words beyond both tables
    joint = np.zeros((k, k))
    for d, t, _ in rows:
        before = 0
        for w in () if held(d) else cut(t):
            joint[before, own.get(w, k - 1)] += 1
            before = context.get(w, k - 1)
    assert (joint == model.joint).all()
    mass = joint.sum(axis=0)
    prior = (mass + 1) / (mass.sum() + k)
    step = (joint + 5 * prior) / (joint.sum(axis=1, keepdims=True) + 5)
    unseen = (sum(n == 1 for n in count.values()) + 0.5) / (mass[-1] + 1)
    def emit(w):
        c = own.get(w, k - 1)
        return unseen / (len(count) + 1) if w not in count else count[w] / mass[c] * (1 - unseen if c == k - 1 else 1)
    for c in range(k):
        assert abs(sum(step[c, own.get(w, k - 1)] * emit(w) for w in count) + step[c, k - 1] * unseen - 1) < 1e-9
    out = {r["doc_id"]: r["score"] for r in scoring.score(symbols, model).collect()}
    for d, t, _ in rows:
        before, want = 0, 0.0
        for w in cut(t):
            want += math.log10(step[before, own.get(w, k - 1)] * emit(w))
            before = context.get(w, k - 1)
        assert abs(out[d] - want) < 1e-6
    assert model.history == sorted(model.history)


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(0)
    n, k = 22, 5  # END, 20 words, tail
    b = rng.poisson(rng.gamma(0.3, 5, (n, n)))

    def likelihood(own):
        g = np.zeros((k, k))
        np.add.at(g, (own[:, None].repeat(n, 1), own[None, :].repeat(n, 0)), b)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    own = scoring.exchange_classes(b, k - 2, 50)
    best = likelihood(own)
    assert own[0] == 0 and own[-1] == k - 1 and best > likelihood(scoring.exchange_classes(b, k - 2, 0))
    for w in range(1, n - 1):
        for c in range(1, k - 1):
            other = own.copy()
            other[w] = c
            assert likelihood(other) <= best + 1e-6


def test_model_beats_base_on_held_out(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(("the", "a")) + " " + rng.choice([f"n{i}" for i in range(50)]) + " " + rng.choice([f"v{i}" for i in range(50)]) for _ in range(40))
    out = scoring.score_documents(table(spark, [(i, text(), None) for i in range(300)]), classes=6)
    base, score = out.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_words_beyond_the_core_take_classes(spark):
    """Nouns and verbs alternate; those beyond the core still find the class of their kind."""
    rng = random.Random(7)
    weight = [1 / (i + 1) for i in range(200)]
    nouns, verbs = [f"n{i}" for i in range(200)], [f"v{i}" for i in range(200)]
    text = lambda: " ".join(f"{a} {b}" for a, b in zip(rng.choices(nouns, weight, k=60), rng.choices(verbs, weight, k=60), strict=True))
    docs = table(spark, [(i, text(), None) for i in range(200)])
    score = lambda **k: scoring.score_documents(docs, clustered=10, classes=2, **k).where("held_out").agg(F.sum("score")).first()[0]
    assert score() > 0.9 * score(classed=0) and score() > score(classed=0) + 100  # log10


def test_joining_a_class_is_the_best_move():
    rng = np.random.default_rng(3)
    k = 6
    joint = rng.integers(50, 400, (k, k)).astype(float)
    joint[-1] += 500
    joint[:, -1] += 500
    left, right = rng.integers(0, 4, (30, k)).astype(float), rng.integers(0, 4, (30, k)).astype(float)
    left[:, -1] = right[:, -1] = 0  # no word beside another of the last class, so the gains are exact
    right[:, 0] += np.maximum(left.sum(axis=1) - right.sum(axis=1), 0)
    left[:, 0] += np.maximum(right.sum(axis=1) - left.sum(axis=1), 0)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

    def likelihood(w, a):
        g = joint.copy()
        g[-1] -= right[w]
        g[:, -1] -= left[w]
        g[a] += right[w]
        g[:, a] += left[w]
        return f(g) - f(joint.sum(axis=0) + np.eye(k)[a] * left[w].sum() - np.eye(k)[-1] * left[w].sum()) - f(joint.sum(axis=1) + np.eye(k)[a] * right[w].sum() - np.eye(k)[-1] * right[w].sum())

    took = scoring.best_classes(np.full(30, k - 1), left, right, joint)
    for w in range(30):
        assert likelihood(w, took[w]) >= max(likelihood(w, a) for a in range(1, k)) - 1e-6


def test_shards(docs, rows):
    eight, nine = dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0)
    out = sharding.assign_shards(docs, eight, nine).toPandas()
    assert len(out) == len(rows)
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert ((out["grown_shard"] == out["shard"]) | (out["grown_shard"] == 8)).all()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(out["size"], out["text_crc32"], strict=True)) == want


def test_shard_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign_shards(df, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert 0.73 < n[1] / 20000 < 0.77


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = packing.pack(docs, PATH, capacity=64)
    want = []
    for d, t, _ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64)]
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    pdf = out.toPandas().sort_values(["sequence_id", "offset"])
    for _, g in pdf.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(PATH)
    for t in ["Ünï’s don't I'LL. café, naïve. ŉ İstanbul Straße ẞ ﬁne x́y T̈ a.b, ...x 12,3. é.", "a\x1cb c d e　f ̸g", "<|endoftext|> x", "'s. 't, it's. y'all'd've.", "", "汉字 kana かな. A" + "b" * 99]:
        assert ids.text(t.encode()) == ids.encode(t)


def test_word_ids_need_no_whole_way_for_letters_and_symbols():
    """Small and large letters share an entry, and symbols after letters are cut off; marks that compose with small letters only keep the large ones."""
    ids, plain = packing.WordIds(PATH), packing.WordIds(PATH)
    for t in ("Boar BOAR boar", "boar&&& été$$$ don't", "H\u0331a \u1e96a h\u0331a", "\u0130&& \u0130a,. I\u0307a"):
        assert ids.text(t.encode()) == plain.encode(t)
    ids.clear()
    whole = []
    ids.encode = lambda text: whole.append(text) or plain.encode(text)
    ids.text("Boar BOAR boar boar&&& Été%%%".encode())
    assert {b"boar", b"boar&&&"} < set(ids) and b"Boar" not in ids and whole == ["&&&", "%%%"]


def test_plan_is_as_good_as_item_by_item():
    rng = random.Random(8)
    for _ in range(20):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 65), 12)}
        plan, sequences = packing.plan_best_fit(counts, 64)
        free: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [f for f in free if f >= n]
                if fits:
                    free.remove(min(fits))
                    free.append(min(fits) - n)
                else:
                    free.append(64 - n)
        assert sequences == len(free) and plan[:, 2].sum() == sum(counts.values())


def test_licenses(docs, spark):
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect() if r["licenses"]}
    assert [r["licenses"] for r in found.values()] == ["MIT"]
    texts = [
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://x",
        "Licensed under the Apache License, Version 2.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "é. Licensed under CC BY-NC 4.0. Released under the MIT License.",
        "license",
    ]
    out = [r["licenses"] for r in licenses.scan_licenses(table(spark, [(i, t, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert out == ["Apache-2.0", "Apache-2.0", "GPL-3.0-or-later", "CC-BY-NC-4.0,MIT", ""]


def found_licenses(spark, texts):
    return [r["licenses"] for r in licenses.scan_licenses(table(spark, [(i, t, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]


MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
]


def test_wrapped_licenses(spark):
    """Sentences over any number of lines; a gap's sentences count once each, however wrapped."""
    wrap = lambda n, parts=MIT: "\n\n".join(textwrap.fill(p, n) for p in parts)
    other = "These words belong to no licence at all but they are long enough to be wrapped over many short lines of the text."
    narrow, commented = wrap(20), "\n".join(f"# {line}".rstrip() for line in wrap(45).split("\n"))
    one_gap = wrap(30, [MIT[0], other, MIT[1]])
    wide_gap = "\n\n".join([MIT[0], other, other, other, MIT[1]])
    assert found_licenses(spark, [wrap(45), narrow, commented, one_gap, wide_gap]) == ["MIT", "MIT", "MIT", "MIT", ""]


@pytest.mark.parametrize(("text", "licence"), [
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under the Creative Commons Attribution-NonCommercial\n3.0 Unported License.", "CC-BY-NC-3.0"),
    ("Released under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later"),
    ("Released under the GNU GPLv3.", "GPL-3.0-only"),
    ("This library is distributed under the terms of the GNU Lesser General Public License v2.1.", "LGPL-2.1-only"),
    ("This software is licensed under the AGPL-3.0 license.", "AGPL-3.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy was not distributed", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Published under CC0 1.0 Universal.", "CC0-1.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\n\nint x;", "GPL-2.0-or-later"),
    ("Licensed under no terms that anyone knows.", ""),
    ("Apples under the tree.", ""),
])
def test_licence_families(text, licence):
    found = licenses.recognise(text.encode(), licenses.reader(licenses.SENTENCES, True), licenses.RULES, 2, re.compile("|".join(licenses.hints(licenses.SENTENCES, True)).encode(), re.IGNORECASE).search)
    assert found[1] == [licence][: bool(licence)]


def test_licence_tables_are_normal_and_hinted(spark):
    assert all(licenses.normal(k.encode()) == k for k in (*licenses.SENTENCES, *licenses._CALLED))
    assert set(licenses._CALLED.values()) | set(licenses.SENTENCES.values()) >= {i for _, wanted in licenses.RULES for i in wanted}
    own = {"software for all": "a", "do as you please": "b"}  # the second has none of the common words
    out = licenses.scan_licenses(table(spark, [(1, "Do as you please.", None)]), sentences=own, rules=(("B", ("b",)),))
    assert [r["licenses"] for r in out.collect()] == ["B"]


OPERATORS = {
    "secrets": secrets.find_secrets, "simhash": simhash.near_groups, "lines": line_dedup.remove_repeated_lines, "scores": scoring.score_documents, "licenses": licenses.scan_licenses,
    "substrings": substring_dedup.remove_repeats, "quality": quality.judge, "shards": lambda d: sharding.assign_shards(d, {0: 1.0}), "packing": lambda d: packing.pack(d, PATH),
    "leaks": lambda d: decontamination.find_leaks(d, d.selectExpr("doc_id AS item_id", "text")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_and_repeated_rows(spark, name):
    out = OPERATORS[name](table(spark, [(None, None, None), (None, None, None), (1, None, None), (1, "a b", None), (1, "a b", None)]))
    assert out.count() == 5
