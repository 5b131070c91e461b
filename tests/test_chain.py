"""The chain from detections to values, on truth tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from figmill.operators import axes, detect, evidence, knowledge, pixels, points, series, tables
from figmill.sources import files

SCHEMA = "paper_id string, figure_id string, det_id long, det_idx int, label string, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double, cx double, cy double"


def box(i, label, cx, cy, w=8, h=8, conf=0.9, figure="f"):
    return ("p", figure, i, i, label, 0, conf, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, float(cx), float(cy))


def plot(y_labels, first=0, figure="f"):
    """An x axis 0 to 4 at 100 to 500 pixels and a left axis with labels at 700, 500, 300 and 100 pixels."""
    rows, texts = [], {}
    for k in range(5):
        rows += [box(first + k, "tick_mark", 100 + 100 * k, 700, 2, 6, figure=figure), box(first + 20 + k, "tick_label", 100 + 100 * k, 730, 20, 12, figure=figure)]
        texts[first + 20 + k] = str(k)
    for k in range(4):
        rows += [box(first + 10 + k, "tick_mark", 100, 700 - 200 * k, 6, 2, figure=figure), box(first + 40 + k, "tick_label", 60, 700 - 200 * k, 30, 12, figure=figure)]
        texts[first + 40 + k] = y_labels[k]
    rows += [box(first + 60, "data_point", 200, 500, figure=figure), box(first + 61, "data_point", 350, 300, figure=figure)]
    rows.append(box(first + 70, "tick_label", 230, 480, 30, 12, figure=figure))  # inside the plot, beside the first point
    texts[first + 70] = "42"
    return rows, texts


POWERS, TENS = ["1e2", "1e3", "1e4", "1e5"], ["1e1", "2e1", "3e1", "4e1"]


def run(spark, y_labels, modes=None):
    rows, texts = plot(y_labels)
    d = spark.createDataFrame(rows, SCHEMA)
    t = spark.createDataFrame(sorted(texts.items()), "det_id long, text string")
    s = spark.createDataFrame([(60, "A")], "det_id long, series string")
    m = None if modes is None else spark.createDataFrame([("p", "f", *modes)], "paper_id string, figure_id string, heatmap boolean, log_x boolean")
    return {r.det_id: r for r in points.mapped(d, t, s, m).collect()}


def test_plain_plot(spark):
    got = run(spark, POWERS)
    assert got[60].series == "A" and got[61].series == "Default"
    assert got[60].x == pytest.approx(1.0) and got[61].x == pytest.approx(2.5)
    # labels written as powers make a logarithmic axis: 500 pixels are 3, 300 are 4
    assert got[60].y_left == pytest.approx(1e3) and got[61].y_left == pytest.approx(1e4)
    assert got[60].y_right_or_value is None


def test_heatmap(spark):
    """A heatmap's y axis is linear and its labels inside the plot become values of near points."""
    got = run(spark, TENS, (True, False))
    assert got[60].y_right_or_value == 42.0 and got[61].y_right_or_value is None
    assert got[60].y_left == pytest.approx(20.0) and got[61].y_left == pytest.approx(30.0)
    plain = run(spark, TENS, (False, False))  # as powers 2e1 and 3e1 are 1.3 and 1.5
    assert plain[60].y_right_or_value is None and plain[60].y_left != pytest.approx(20.0)
    assert run(spark, TENS, (False, True))[60].x == pytest.approx(10.0)


def test_cleaned(spark):
    rows = [box(1, "data_point", 50, 50, conf=0.9), box(2, "data_point", 51, 50, conf=0.8), box(3, "text", 50, 50, 40, 40)]
    rows += [box(100 + i, "marker", 300 + 3 * i, 300, 2, 2, conf=0.3 + 0.2 * (i % 2), figure="g") for i in range(160)]
    got = {r.det_id for r in points.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 2 overlaps 1, which the larger text covers; of the crowded figure only confident boxes stay
    assert {i for i in got if i < 100} == {3} and {i for i in got if i >= 100} == {101 + 2 * i for i in range(80)}


@pytest.mark.parametrize("fold", [1, 4, 10_000])
def test_both_ways_of_suppression_agree(spark, fold):
    from tests.test_detect import SCHEMA as S, boxes, greedy

    rows = boxes(11, 90)
    rows += [(*r[:2], 1000 + i, *r[3:]) for i, r in enumerate(rows[:10])] + [(None, "f0", 2000, "a", 0.5, 1.0, 1.0, 9.0, 9.0, 5.0, 5.0), ("p", "f0", 2001, "a", 0.5, None, 1.0, 9.0, 9.0, 5.0, 5.0)]
    got = {r.det_id for r in detect.suppressed(spark.createDataFrame(rows, S), fold=fold).collect()}
    assert got == greedy([r for r in rows if r[5] is not None and r[0]], 0.5) | {2000, 2001}


def test_level_line(spark):
    """Labels that share one pixel make no pair; least squares gives a level line at their mean."""
    c = spark.createDataFrame([("p", "f", "x", i, 50.0, 700.0, "t", v) for i, v in enumerate((1.0, 2.0, 6.0))], "paper_id string, figure_id string, axis string, det_id long, cx double, cy double, text string, value double")
    r = axes.fit(c, axes.log_votes(c)).collect()
    assert [(x.slope, x.intercept, x.inliers) for x in r] == [(0.0, 3.0, 3)]


def test_pixels(spark):
    rows = [("a", float(x), float(y), 5.0, 5.0, 250.0 if x < 2 else 100.0, 200.0, 40.0, 40.0) for x in range(5) for y in range(5)] + [("b", 0.0, 0.0, 1.0, 1.0, 255.0, 0.0, 0.0, 255.0)]
    p = spark.createDataFrame(rows, "k string, x double, y double, w double, h double, grey double, r double, g double, b double")
    assert {r.k: (r.white, r.heatmap) for r in pixels.heatmaps(p, ["k"]).collect()} == {"a": (0.4, True), "b": (1.0, False)}
    assert {r.k: (r.h, r.s, r.v) for r in pixels.weighted_colour(p, ["k"]).collect()} == {"a": (0.0, 204.0, 200.0), "b": (120.0, 255.0, 255.0)}
    assert pixels.weighted_colour(p.limit(0), ["k"]).count() == 0
    # the middle weighs most
    edge = spark.createDataFrame([("c", float(x), 0.0, 3.0, 1.0, 255.0 if x == 1 else 0.0, 0.0, 0.0) for x in range(3)], "k string, x double, y double, w double, h double, r double, g double, b double")
    assert pixels.weighted_colour(edge, ["k"]).first().v > 255 / 3 + 20


def test_wide_fusion(spark):
    item = "array<struct<text: string, source_file: string, note: string>>"
    te = ([("Time / h", "x_0.png", None)], [("Yield", "y_0.png", None)], None, None)
    rows = [(1, "p", ("f", None, None), te, [("A", 1.0, 2.0, None), ("B", 2.0, float("nan"), 7.0)]), (2, "q", ("g", None, None), ([("Yield", "a", None)], [("Yield", "b", None)], None, None), [(None, 1.0, 2.0, None)])]
    p = spark.createDataFrame(rows, f"packet_id long, paper_id string, meta struct<figure_id: string, source_intermediate_dir: string, caption: string>, text_evidence struct<x_axis_title: {item}, y_axis_title: {item}, chart_text: {item}, legend_text: {item}>, raw_data array<struct<Series: string, X: double, Y_Left: double, Y_Right: double>>")
    known = knowledge.replies(spark.createDataFrame([("p", '```json\n{"term_mapping": {"A": "acid"}, "global_conditions": {"Solvent": "toluene"}}\n```'), ("q", "no JSON")], "paper_id string, reply string"), "paper_id")
    got = {(r.packet_id, r.point_no): r.row for r in evidence.fused_wide(p, known).collect()}
    assert got[(1, 0)] == {"Series": "A (acid)", "Time / h": "1.0", "Yield": "2.0", "Condition: Solvent": "toluene"}
    assert got[(1, 1)] == {"Series": "B", "Time / h": "2.0", "Yield": None, "Data_Value": "7.0", "Condition: Solvent": "toluene"}
    assert got[(2, 0)] == {"Series": "Unknown", "Yield": "2.0"}
    assert evidence.fused_wide(p.limit(0), known).count() == 0


def test_linked_documents(spark):
    f = spark.createDataFrame([(1, "d/page_1_evidence.json", "out/paper7/x"), (2, "d/paper8_page_1_evidence.json", None), (3, "lone/page_2_evidence.json", "out"), (4, "lone/other.json", "out"), (5, None, None)], "file_id long, file_name string, source_dir string")
    n = spark.createDataFrame([("paper7",), ("paper8",), ("lone",), ("none",), ("",), (None,)], "name string")
    assert sorted((r.name, r.file_id, r.fallback) for r in evidence.linked(n, f).collect()) == [("lone", 3, True), ("paper7", 1, False), ("paper8", 2, False)]


def test_masks_and_files(spark, tmp_path):
    t = spark.createDataFrame([("p", 1, "figure", 10.0, 10.0, 110.0, 110.0)], "k string, det_id long, label string, x1 double, y1 double, x2 double, y2 double")
    e = spark.createDataFrame([("p", 2, "text", 5.0, 20.0, 30.0, 40.0), ("p", 3, "text", 20.0, 105.0, 90.0, 130.0), ("p", 4, "mark", 300.0, 0.0, 310.0, 5.0)], t.schema)
    got = {r.element_id: r for r in tables.target_elements(t, e, ["k"]).collect()}
    assert set(got) == {2, 3} and tuple(got[2].mask) == (0.0, 10.0, 20.0, 30.0) and got[3].label == "caption" and got[3].mask is None
    img = spark.createDataFrame([(0, "a.png"), (1, "b.png")], "id long, file_name string")
    doc = files.coco_document(img, spark.createDataFrame([(7, 0)], "id long, image_id long"), spark.createDataFrame([(0, "x")], "id long, name string"))
    files.write_coco(doc, str(tmp_path / "coco"))
    back = spark.read.text(str(tmp_path / "coco"))
    assert back.groupBy("part").count().orderBy("part").collect() == [("annotations", 1), ("categories", 1), ("images", 2), ("info", 3)]
    uri = spark.createDataFrame([("a.webp", b"x" * 100)], "path string, content binary").select(files.data_uri(F.col("path"), F.col("content")).alias("u")).first().u
    assert uri.startswith("data:image/webp;base64,eHh4") and "\n" not in uri


def test_nearest_centre_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [("p", f"t{i % 3}", i, float(rng.randrange(300)) + rng.random(), float(rng.randrange(300))) for i in range(120)]
    c = spark.createDataFrame(rows, "paper_id string, table_id string, cell_id long, cx double, cy double")
    centres = [(r.table_id, r.centre, r.ord) for r in tables.gap_clusters(c, "cx", 4.0).collect()]
    want = {r[2]: min((abs(m - r[3]), o) for t, m, o in centres if t == r[1])[1] for r in rows}
    assert {r.cell_id: r.col_index for r in tables.assigned(c, 4.0).collect()} == want


def test_series_colours(spark):
    marks = spark.createDataFrame([("p", "f", "A", 0.0, 200.0, 200.0), ("p", "f", "B", 90.0, 200.0, 200.0), ("p", "f", "A", 4.0, 200.0, 200.0)], "paper_id string, figure_id string, series string, h double, s double, v double")
    protos = series.prototypes(marks)
    assert {r.series: (r.h, r.n) for r in protos.collect()} == {"A": (2.0, 2), "B": (90.0, 1)}
    p = spark.createDataFrame([("p", "f", 1, 178.0, 200.0, 200.0), ("p", "f", 2, 80.0, 200.0, 200.0)], "paper_id string, figure_id string, det_id long, h double, s double, v double")
    assert {r.det_id: r.series for r in series.nearest_series(p, protos).collect()} == {1: "A", 2: "B"}


def test_both_ways_to_a_model_agree(spark):
    import random

    rng, rows = random.Random(6), []
    for f in range(12):
        for axis in ("x", "yl", "yr"):
            for k in range(rng.choice((1, 2, 3, 6, 12, 30))):
                at, off = 60.0 * k + rng.random(), rng.choice((0.0, 0.0, 3.0, 45.0))
                cx, cy = (at, 700 + off) if axis == "x" else (60 + off, at)
                value = rng.choice((2.0 * k + 1, 2.0 * k + 1, 10.0**k, -5.0, 7000.0))
                rows.append(("p", f"f{f}", axis, len(rows), cx, cy, rng.choice(("10^2", "1e3", "5")), value))
    c = spark.createDataFrame(rows, "paper_id string, figure_id string, axis string, det_id long, cx double, cy double, text string, value double")
    m = spark.createDataFrame([("p", "f0", True, False), ("p", "f1", False, True)], "paper_id string, figure_id string, heatmap boolean, log_x boolean")
    for modes in (None, m):
        a, b = ({(r.figure_id, r.axis): r for r in axes.models(c, modes, fold=n).collect()} for n in (1000, 2))
        assert set(a) == set(b) and any(r.slope is not None for r in a.values()) and any(r.slope is None for r in a.values())
        for k, r in a.items():
            assert (r.is_log, r.inliers) == (b[k].is_log, b[k].inliers) and r.line == pytest.approx(b[k].line)
            assert r.slope == (None if b[k].slope is None else pytest.approx(b[k].slope, abs=1e-9)) and r.intercept == (None if b[k].intercept is None else pytest.approx(b[k].intercept))
    assert axes.models(c.limit(0)).count() == 0
