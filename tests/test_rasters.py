"""Images and relational plans whose memory and disk don't follow from the optimizer's estimates."""

import numpy as np

from strandlace.operators import ridges
from strandlace.plans.catalogue import QUERIES
from strandlace.sources.images import DotFile, image_files, image_pixels, png, read_dot, read_png

SIZES = [(1, "a", 3, 2), (1, "b", 2, 2), (2, "a", 0, 0), (3, "a", 70000, 1)]
LIT = [(1, "a", 2, 1, 9), (1, "a", 0, 0, 255), (1, "c", 1, 1, 7), (3, "a", 69999, 0, 5), *((3, "a", x, 0, 1 + x % 200) for x in range(30000))]


def frames(spark):
    return spark.createDataFrame(LIT, "id int, name string, px long, py long, value long"), spark.createDataFrame(SIZES, "id int, name string, width long, height long")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_image_files_hold_their_own_pixels(spark):
    lit, sizes = frames(spark)
    key = ["id", "name"]
    files = image_files(lit, sizes, key, lambda image: DotFile(1.0, image, 12, 8, "DNA").to_bytes())
    assert "BroadcastExchange" not in plan(files)
    assert files.count() == len(SIZES)
    # A plot without a size ("c") has no image, and its pixels are in no other.
    assert {tuple(r) for r in image_pixels(files, key, lambda data: read_dot(data).image).collect()} == {r for r in LIT if r[1] != "c"}
    some = image_files(lit, sizes.where("width > 0"), key, png)
    assert {tuple(r) for r in image_pixels(some, key, lambda data: read_png(data)[0]).collect()} == {r for r in LIT if r[1] != "c"}


def test_render_every_pixel(spark):
    lit, sizes = frames(spark)
    out = ridges.render(lit, sizes, ["id", "name"], 10, 60)
    assert "BroadcastExchange" not in plan(out)
    got = {tuple(r)[:4]: r["grey"] for r in out.collect()}
    value = {r[:4]: r[4] for r in LIT}
    due = {(i, n, x, y): value.get((i, n, x, y), 0) for i, n, w, h in SIZES for x in range(w) for y in range(h)}
    grey = lambda v: 255 if v <= 10 else 0 if v >= 60 else int(np.floor(255.5 - (v - 10) * 5.1))
    assert got == {k: grey(v) for k, v in due.items()}


def test_images_of_small_files_are_no_broadcast(spark):
    for name in ("dot_file_roundtrip", "png_roundtrip", "render_dense"):
        assert "BroadcastExchange" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_relational_plans_shuffle_no_positions(spark):
    """One exchange of whole records, besides the one that pairs the turns; no join, and no window over cells."""
    for name, exchanges in (("pg_relational", 1), ("dot_forward_relational", 2)):
        text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Join" not in text and text.count("Exchange hashpartitioning") == exchanges, text


def test_relational_periodogram_keeps_rows_of_one_key_apart(spark):
    from strandlace.operators import periodogram as P

    df = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGTAC"), (1, "AAAAAAAAAAAAAAAAAAAAA"), (2, None), (3, "AC"), (4, "acgNacgNacgNacgNacgNacgN")], "id int, seq string")
    cfg = P.PeriodogramConfig(max_offset=12)
    assert sorted(map(tuple, P.periodogram_relational(df, "id", "seq", cfg).collect())) == sorted(map(tuple, P.periodogram(df, "id", "seq", cfg).collect()))


def test_strands_are_merged_where_they_are_scored(spark):
    import random

    from strandlace.operators.kernel import block_strands
    from strandlace.plans.dotplot import PlotConfig, dotplot

    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("ACGTN" if n % 2 else "ACGT", k=n))
    rows = [(i, word(n), word(m)) for i, (n, m) in enumerate([(60, 45), (61, 80), (9, 200), (4, 4), (150, 150)])] + [(9, None, "ACGT")]
    df = spark.createDataFrame(rows, "id int, query string, subject string")
    for zoom in (1, 3):
        cfg = PlotConfig(strand="both", zoom=zoom)
        apart = {"forward": {}, "reverse": {}}
        for r in dotplot(df, ["id"], cfg, separate=True).collect():
            apart[r["channel"]][r["id"], r["px"], r["py"]] = r["value"]
        due = {k: tuple(apart[c].get(k, 0) for c in apart) for k in apart["forward"] | apart["reverse"]}
        out = block_strands(df, ["id"], "query", "subject", cfg.scoring, 8, zoom, 12, band_cells=2000)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == due and out.count() == len(due)
        merged = dotplot(df, ["id"], cfg)
        assert {tuple(r)[:3]: r["value"] for r in merged.collect()} == {k: max(v) for k, v in due.items()}
        assert "HashAggregate" not in plan(merged)


def test_resize_places_each_target(spark):
    """Every target shows the pixel at floor(target * source / size); larger and smaller plots, and no join in the query."""
    sizes = [(1, 7, 5), (2, 50, 3), (3, 123, 200), (4, 1, 1)]
    rows = [(i, x, y, 1 + (x * 31 + y) % 250, w, h) for i, w, h in sizes for x in range(w) for y in range(h)]
    df = spark.createDataFrame(rows, "id int, px long, py long, value long, width long, height long")
    due = {}
    for i, w, h in sizes:
        oh = max(1, 50 * h // w)
        due |= {(i, x, y): 1 + (x * w // 50 * 31 + y * h // oh) % 250 for x in range(50) for y in range(oh)}
    got = ridges.resize_nearest(df, None, ["id"], 50).collect()
    assert {tuple(r)[:3]: r["value"] for r in got} == due and len(got) == len(due)
    assert "Join" not in plan(QUERIES["resize_nearest"](spark, "/root/testdata/sf0.001"))


def test_self_plots_are_scored_once_and_up_to_the_diagonal(spark, monkeypatch):
    from strandlace.operators import kernel

    seqs = [(1, "ACGTTGCA" * 60), (2, "ACCA" * 5), (3, "")]
    df = spark.createDataFrame([(i, s, s) for i, s in seqs], "id int, query string, subject string")
    from strandlace.plans.dotplot import PlotConfig, dotplot

    both = dotplot(df, ["id"], PlotConfig(zoom=7, self_plot=True))
    assert plan(both).count("MapInArrow") == 1
    lower = {tuple(r) for r in dotplot(df, ["id"], PlotConfig(zoom=7, self_plot=True, triangle="lower")).collect()}
    assert sorted(map(tuple, both.collect())) == sorted(lower | {(i, y, x, v) for i, x, y, v in lower})

    q, cells, sums = kernel.Scoring().codes(seqs[0][1]), [], kernel.window_sums
    monkeypatch.setattr(kernel, "window_sums", lambda m, w: cells.append(m.size) or sums(m, w))
    triangle, square = (list(kernel.block_pixels(q, q, kernel.Scoring(), 8, 40, 12, False, own)) for own in (True, False))
    points = lambda parts: {p for x, y, v in parts for p in zip(x.tolist(), y.tolist(), v.tolist(), strict=True)}
    # Off the diagonal, half of the square.
    assert {p for p in points(triangle) if p[0] != p[1]} == {p for p in points(square) if p[0] < p[1]}
    rows = -(-len(q) // 40)
    assert sum(cells[:rows]) < 0.7 * sum(cells[rows:])


def test_record_tiles_are_sampled_where_they_are_scored(spark):
    """As record_tiles of the pixels; the only shuffle after the kernel is that of sampled cells."""
    import random

    from strandlace.operators import kernel
    from strandlace.operators.tiles import record_tiles
    from strandlace.plans import dotplot as D

    rng = random.Random(8)
    x_spans, y_spans, pairs = [], [], []
    for i, (xs, ys) in enumerate([((40, 0, 33, 71), (52,)), ((9,), (30, 1, 14)), ((25, 12), ()), ((0, 64), (44, 21))]):
        text = lambda n: "".join(rng.choices("ACGT", k=n))
        pairs.append((i, text(sum(xs) + 5), text(sum(ys) + 15)))
        for out, sizes in ((x_spans, xs), (y_spans, ys)):
            out += [(i, sum(sizes[:j]), sum(sizes[: j + 1])) for j in range(len(sizes))]
    df = spark.createDataFrame([*pairs, (9, "ACGT" * 9, "ACGT" * 9), (10, None, "ACGT")], "id int, query string, subject string")
    xs, ys = (spark.createDataFrame(x, "id int, start long, stop long") for x in (x_spans, y_spans))
    for strand in ("forward", "reverse"):
        cfg = D.PlotConfig(window=4, strand=strand)
        due = sorted(map(tuple, record_tiles(D.dotplot(df, ["id"], cfg), xs, ys, ["id"], 7).collect()))
        out = D.tiled_dotplot(df, xs, ys, ["id"], 7, cfg)
        assert sorted(map(tuple, out.collect())) == due and due
    assert kernel.onto_cells(tuple(np.zeros(1, np.int64) for _ in range(3)), [[], []], 7)[0].size == 0
    text = plan(QUERIES["tile_records"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in text[: text.index("MapInArrow")]


def drawable(spark):
    """Pairs of plots of one strip and of several, with unknown letters, shorter than a window, empty and null."""
    import random

    rng = random.Random(5)
    word = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    pairs = [(1, word(60), word(45)), (2, word(61, "ACGTN"), word(80)), (3, word(9), word(200)), (4, "ACGT", "AC"), (5, "", "ACGTA"), (6, "ACGTA", ""), (7, None, "ACGT"), (8, "ACGT", None), (9, word(3000), word(1500))]
    df = spark.createDataFrame(pairs, "id int, query string, subject string")
    return df, df.selectExpr("id", "length(query) AS width", "length(subject) AS height")


def test_every_pixel_is_drawn_where_it_is_scored(spark):
    """As rendered from shuffled pixels; each image row comes once, and the query shuffles pairs only."""
    from strandlace.operators.kernel import Scoring, block_images
    from strandlace.plans.dotplot import PlotConfig, dotplot, drawn_dotplot

    df, sizes = drawable(spark)
    draw = ridges.grey_rows(10, 60)
    for strand, zoom in (("forward", 1), ("reverse", 1), ("both", 3)):
        cfg = PlotConfig(strand=strand, zoom=zoom)
        zoomed = sizes.selectExpr("id", f"ceil(width / {zoom}) AS width", f"ceil(height / {zoom}) AS height")
        dense = ridges.render(dotplot(df, ["id"], cfg), zoomed, ["id"], 10, 60)
        due = sorted(map(tuple, dense.groupBy("id", "py").agg({"px": "count", "grey": "sum"}).select("id", "py", "count(px)", "sum(grey)").collect()))
        out = drawn_dotplot(df, ["id"], draw, ridges.GREY_ROWS, cfg)
        assert sorted(map(tuple, out.collect())) == due and {r[0] for r in due} == {1, 2, 3, 4, 9}
        sides = {"forward": (False,), "reverse": (True,), "both": (False, True)}[strand]
        banded = block_images(df, ["id"], "query", "subject", Scoring(), 8, zoom, 12, sides, draw, ridges.GREY_ROWS, band_cells=2000)
        assert sorted(map(tuple, banded.collect())) == due
    text = plan(QUERIES["render_dense"](spark, "/root/testdata/sf0.001"))
    assert text.count("MapInArrow") == 1 and text.count("Exchange") == 2, text


def test_image_files_are_drawn_where_they_are_scored(spark):
    """The same files as those of shuffled pixels, empty plots included, and the queries shuffle pairs only."""
    from strandlace.plans.dotplot import PlotConfig, dotplot, drawn_dotplot
    from strandlace.sources.images import IMAGE_FILES, image_file

    df, sizes = drawable(spark)
    encode = lambda image: DotFile(1.0, image, 12, 8, "DNA").to_bytes()
    for strand in ("forward", "both"):
        cfg = PlotConfig(strand=strand)
        due = {r["id"]: bytes(r["data"]) for r in image_files(dotplot(df, ["id"], cfg), sizes.dropna(), ["id"], encode).collect()}
        got = drawn_dotplot(df, ["id"], image_file(encode), IMAGE_FILES, cfg, whole=True).collect()
        assert {r["id"]: bytes(r["data"]) for r in got} == due and len(got) == len(due) == 7
    for name in ("dot_file_roundtrip", "png_roundtrip"):
        text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert text.count("MapInArrow") == 2 and text.count("Exchange") == 2, text
