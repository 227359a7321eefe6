"""Axis marks: steps, records cut at the axis's end, narrow ones left out, and their SVG."""

from xml.etree import ElementTree

from strandlace.plans.axes import axis_marks, mark_elements


def test_marks(spark):
    sizes = spark.createDataFrame([(1, 400, 30), (2, 3, 0)], "id long, width int, height int")
    spans = spark.createDataFrame([(1, "x", "first", 0, 100), (1, "x", "narrow", 100, 117), (1, "x", "just", 117, 135), (1, "x", "cut", 300, 999), (1, "x", "beyond", 400, 500), (1, "x", "none", 9, 9), (1, "y", "short", 0, 12), (1, "y", "thin", 12, 23), (9, "x", "other", 0, 99)], "id long, axis string, name string, start long, stop long")
    rows = axis_marks(sizes, ["id"], spans).collect()
    of = lambda i, axis, kind: sorted((r["at"], r["label"]) for r in rows if (r["id"], r["axis"], r["kind"]) == (i, axis, kind))
    assert of(1, "x", "major") == [(float(t), str(t)) for t in range(0, 401, 50)]
    assert [t for t, _ in of(1, "x", "minor")] == [float(t) for t in range(0, 401, 10)]
    assert of(1, "x", "record") == [(50.0, "first"), (126.0, "just"), (350.0, "cut")]
    assert of(1, "y", "record") == [(6.0, "short")]
    assert [t for t, _ in of(1, "y", "major")] == [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0] and [t for t, _ in of(1, "y", "minor")] == [float(t) for t in range(31)]
    assert of(2, "y", "major") == [(0.0, "0")] and of(2, "x", "minor") == [] and len(of(2, "x", "major")) == 4


def test_elements(spark):
    sizes = spark.createDataFrame([(1, 40, 20)], "id long, width int, height int")
    spans = spark.createDataFrame([(1, "x", "a<b & c", 0, 40)], "id long, axis string, name string, start long, stop long")
    text = mark_elements(axis_marks(sizes, ["id"], spans), ["id"], 60).first()["elements"]
    drawn = ElementTree.fromstring(f"<g>{text}</g>")
    texts = [t.text for t in drawn.iter("text")]
    assert texts[-1] == "a<b & c" and drawn.find("path").get("d") == "M60.0 60v-3"
