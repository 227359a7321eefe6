"""Views of stored plots against fresh plots of their slices."""

import random

import pytest
from pyspark.sql import functions as F

from strandlace.plans import plot_store
from strandlace.plans.dotplot import PlotConfig, PlotError, dotplot
from strandlace.plans.plot_store import PlotStore, rect_zoom
from strandlace.session import options

KEY = ["id"]


def pairs_of(spark, seed=1, sizes=((60, 90), (2500, 1300), (7, 300), (0, 5), (40, 40))):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = [(i, dna(n), dna(m)) for i, (n, m) in enumerate(sizes)]
    motif = rows[1][1][400:900]
    rows[1] = (1, rows[1][1], rows[1][2][:200] + motif + rows[1][2][700:])
    rows += [(20, *rows[0][1:]), (21, None, "ACGT" * 9)]
    return spark.createDataFrame(rows, "id long, query string, subject string")


def views_of(spark, named, seed, zooms=(1, 2, 3, 8)):
    rng = random.Random(seed)
    out = []
    for r in named.collect():
        n, m = len(r["query"] or ""), len(r["subject"] or "")
        for _ in range(3):
            a, b = sorted(rng.randrange(n + 1) for _ in range(2))
            c, d = sorted(rng.randrange(m + 1) for _ in range(2))
            out.append((r["plot"], a, b, c, d, rng.choice(zooms), r["id"]))
        out.append((r["plot"], 0, n, 0, m, rng.choice(zooms), r["id"]))
    return spark.createDataFrame(out, plot_store.VIEW + ", id long")


def fresh(spark, named, views, cfg):
    """Each view as a plot of its own."""
    want = set()
    text = {r["id"]: r for r in named.collect()}
    views = views.collect()
    for zoom in {v["zoom"] for v in views}:
        cut = [(i, (text[v["id"]]["query"] or "")[v["q_start"] : v["q_stop"]], (text[v["id"]]["subject"] or "")[v["s_start"] : v["s_stop"]]) for i, v in enumerate(views) if v["zoom"] == zoom]
        for p in dotplot(spark.createDataFrame(cut, "k long, query string, subject string"), ["k"], PlotConfig(**{**cfg.__dict__, "zoom": zoom})).collect():
            v = views[p["k"]]
            want.add((v["id"], v["q_start"], v["q_stop"], v["s_start"], v["s_stop"], v["zoom"], p["px"], p["py"], p["value"]))
    return want


@pytest.mark.parametrize("cfg", [PlotConfig(), PlotConfig(window=5, factor=30, strand="reverse")], ids=["forward", "reverse"])
@pytest.mark.parametrize("few", [100, 0])
def test_views_equal_fresh_plots(spark, tmp_path, monkeypatch, cfg, few):
    monkeypatch.setattr(plot_store, "FEW", few)
    store = PlotStore(spark, str(tmp_path), cfg)
    named = store.named(pairs_of(spark))
    assert store.add(named) == 6  # one pair comes twice
    views = views_of(spark, named, 4)
    rows = store.views(views).collect()
    got = {(r["id"], r["q_start"], r["q_stop"], r["s_start"], r["s_stop"], r["zoom"], r["px"], r["py"], r["value"]) for r in rows}
    assert len(got) == len(rows) and got == fresh(spark, named, views.dropDuplicates(), cfg)


def test_nothing_is_scored_twice(spark, tmp_path):
    store = PlotStore(spark, str(tmp_path))
    first = pairs_of(spark, 1)
    assert store.add(first) == 6
    before = store._read("cells", plot_store.CELLS).count()
    assert PlotStore(spark, str(tmp_path)).add(first) == 0
    assert store.add(first.unionByName(pairs_of(spark, 2).where("id < 3"))) == 3
    # Other scores make other plots; a run that failed before it listed its plots is not read.
    other = PlotStore(spark, str(tmp_path), PlotConfig(factor=20))
    assert other.add(first.where("id = 0")) == 1
    named = store.named(first.where("id = 1"))
    views = views_of(spark, named, 3)
    want = sorted(map(tuple, store.views(views).collect()))
    store._read("cells", plot_store.CELLS).drop("run").where("px < 50").withColumn("value", F.lit(255).cast("long")).write.parquet(f"{tmp_path}/cells/run=failed")
    assert sorted(map(tuple, store.views(views).collect())) == want and before > 0


def test_a_view_reads_its_tiles(spark, tmp_path):
    store = PlotStore(spark, str(tmp_path))
    store.add(pairs_of(spark))
    plot = store.named(pairs_of(spark).where("id = 1")).first()["plot"]
    view = spark.createDataFrame([(plot, 1100, 1200, 20, 90, 1)], plot_store.VIEW)
    with options(spark, **{"spark.sql.maxMetadataStringLength": "4000"}):
        plan = store.views(view)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "tx" in line)
    pushed = scan[scan.index("PushedFilters") :]
    assert f"EqualTo(plot,{plot})" in pushed and "GreaterThanOrEqual(tx,1)" in pushed and "LessThanOrEqual(ty,0)" in pushed


def test_rect_zoom(spark):
    view = F.struct(F.lit(100).cast("long").alias("q_start"), F.lit(50).cast("long").alias("s_start"), F.lit(4).cast("long").alias("zoom"))
    size = F.lit(1000).cast("long")

    def zoom(x0, x1, y0, y1, width=40, height=30):
        return spark.range(1).select(rect_zoom(*map(F.lit, (x0, x1, y0, y1)), view, size, size, width, height).alias("v")).first()["v"]

    v = zoom(50, 10, 5, 15)
    # Columns 10 to 50 at zoom 4 are residues 140 to 300, rows 5 to 15 residues 70 to 110.
    assert (v["q_start"], v["q_stop"], v["s_start"], v["s_stop"], v["zoom"]) == (60, 380, 50, 130, 4)
    assert (v["x"], v["y"]) == (20.0, 5.0)
    assert zoom(10, 12.9, 5, 50) is None and zoom(10, 13, 5, 8)["zoom"] == 1
    v = zoom(-20, 9999, 0, 9999)
    assert (v["q_start"], v["q_stop"], v["s_start"], v["s_stop"], v["zoom"]) == (0, 1000, 0, 1000, 32)


def test_history(spark, tmp_path):
    store = PlotStore(spark, str(tmp_path))
    assert store.back().count() == 0
    view = lambda name, k: spark.createDataFrame([(name, "p", k, 9, 0, 9, 1)], "session string, " + plot_store.VIEW)
    for name, k in (("a", 1), ("a", 2), ("b", 7), ("a", 3)):
        store.remember(view(name, k))
    assert {(r["session"], r["q_start"]) for r in store.back().collect()} == {("a", 2)}
    assert {(r["session"], r["q_start"], r["at"]) for r in store.back(0).collect()} == {("a", 3, 2), ("b", 7, 0)}


@pytest.mark.parametrize("cfg", [PlotConfig(window=None), PlotConfig(factor=0), PlotConfig(zoom=2), PlotConfig(strand="both"), PlotConfig(self_plot=True)])
def test_refused(spark, tmp_path, cfg):
    with pytest.raises(PlotError):
        PlotStore(spark, str(tmp_path), cfg)
