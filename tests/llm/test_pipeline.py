"""Pipeline stages against brute force, and registered queries against their SQL."""

import os
import random

import brute
import corpus_pipeline
import pytest
from strandlace.llm import entries, simhash, stages
from test_operators import corpus, table, unique
from verify import compare, duck

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=repr)


def alike(rows):
    """A group number for each row: components of five-word shingle similarity 0.8 or more."""
    grams = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in ((t or "").translate(brute.LOWER).split() for _, t, *_ in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_stages(spark, tmp_path):
    rows = [r for r in unique(corpus()) if r[0] is not None]
    docs = table(spark, rows)
    spark.createDataFrame([(1, "edit")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = stages.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    fine = {d for d, _, ok in brute.judge(rows) if ok}
    left = [(d, t) for d, t, _ in rows if d in fine]
    assert texts(kept) == sorted(left, key=repr)
    lines = stages.line_stage(spark, kept, str(tmp_path))
    assert lines.columns == docs.columns
    left = [(d, t) for d, _, n, t in brute.line_dedup(left) if not n or brute.WORD.search(t)]
    assert texts(lines) == sorted(left, key=repr)
    near = stages.near_stage(spark, lines, str(tmp_path))
    assert near.columns == docs.columns
    groups = alike(left)
    left = [x for i, x in enumerate(left) if i == min((j for j in range(len(left)) if groups[j] == groups[i]), key=lambda j: left[j][0])]
    assert texts(near) == sorted(left, key=repr)
    clean = stages.leak_stage(spark, near, str(tmp_path))
    assert clean.columns == docs.columns
    hit = {r[0] for r in brute.leaks(left, [(1, "edit")]) if r[-1]}
    assert texts(clean) == sorted(((d, t) for d, t in left if d not in hit), key=repr)
    assert {r["doc_id"] for r in stages.packing_stage(spark, clean, str(tmp_path)).collect()} == {d for d, _ in left} - hit


def test_any_column_name(spark, tmp_path):
    """Columns named like the operators' own, with dots and back-quotes, pass through all stages."""
    names = ["doc_id", "text", "source", "a.b", "_sl_row", "_sl_th", "n_words", "kept", "host", "x`y", "did", "_sl_part"]
    a, b = far_texts(2, 40)
    rows = [(1, a, "s", *range(9)), (2, a, "s", *range(9)), (3, b, None, *range(9)), (None, None, None, *[None] * 9)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    spark.createDataFrame([(1, "edit")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
    assert sorted(tuple(r) for r in docs.collect()) == [rows[0], rows[2]]
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name


def far_texts(n, words=60):
    rng = random.Random(n)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def test_near_stage_null_and_repeated_ids(spark, tmp_path):
    """Different texts all stay, whatever their ids; copies of one text are one document still."""
    a, b, c, d, e = far_texts(5)
    docs = table(spark, [(None, a, None), (None, b, None), (7, c, None), (7, d, None), (8, d, None), (9, e, None), (9, e, None)])
    assert texts(stages.near_stage(spark, docs, str(tmp_path))) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e)], key=repr)


def test_near_copies_go_and_others_stay(spark, tmp_path):
    """The pipeline's stage against all pairs: copies at 0.8 to 0.95 go, looser ones stay; ids may be null or repeated."""
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    rng, rows = random.Random(1), []
    for i, t in enumerate(far_texts(60, 200)):
        copy = t.split()
        for at in rng.sample(range(200), 1 + i % 8):
            copy[at] = f"edit{at}"
        rows += [(10 * i if i % 5 else None, t, None), (10 * i + 5 if i % 7 else 3, " ".join(copy), None)]
    rows += [(1, " \n", None), (2, "", None), (2, None, None)]
    group = alike(rows)
    out = stage(spark, table(spark, rows), str(tmp_path)).collect()
    assert 20 < len(rows) - len(set(group)) < 50 and len(out) == len(set(group))
    assert {group[next(k for k, (d, t, _) in enumerate(rows) if (d, t) == (r["doc_id"], r["text"]))] for r in out} == set(group)


def test_large_group_of_near_copies_is_one(spark):
    base = far_texts(1, 120)[0].split()
    rng, rows = random.Random(2), []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(copy), None))
    for limit, size in ((2048, 1 << 20), (200, 20_000)):
        groups = simhash.near_texts(table(spark, rows), shard_limit=limit, tree_bytes=size)
        assert groups.count() == 1500 and groups.select("root").distinct().count() == 1


def test_survivor_does_not_depend_on_row_order(spark, tmp_path):
    rows = [(1, "one two three four five six", s) for s in ("b", "a", "c")] + [(2, "one two three four five six", "A")]
    for order in (rows, rows[::-1]):
        out = stages.near_stage(spark, table(spark, order), str(tmp_path)).collect()
        assert [(r["doc_id"], r["source"]) for r in out] == [(1, "a")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing"
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, entries.queries()[name], entries.oracle_sql()[name], SF) == ""
