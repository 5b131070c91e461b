import random

import pytest
from pyspark.sql import functions as F

from figmill.operators import axes, detect, series

SCHEMA = "paper_id string, figure_id string, det_id long, label string, conf double, x1 double, y1 double, x2 double, y2 double, cx double, cy double"


def boxes(seed, n, figures=3, spread=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.randrange(spread), rng.randrange(spread), rng.randrange(1, 60), rng.randrange(1, 60)
        out.append(("p", f"f{rng.randrange(figures)}", i, rng.choice("ab"), rng.choice([0.1, 0.5, 0.5, 0.9]), float(x), float(y), float(x + w), float(y + h), x + w / 2, y + h / 2))
    return out


def inter(a, b):
    return max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))


def area(a):
    return (a[7] - a[5]) * (a[8] - a[6])


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2])):
        if all(k[1] != r[1] or k[3] != r[3] or inter(k, r) / (area(k) + area(r) - inter(k, r)) <= t for k in kept):
            kept.append(r)
    return {r[2] for r in kept}


def nested(rows, t):
    keep = {r[2]: True for r in rows}
    for a in rows:
        for b in rows:
            if not keep[a[2]]:
                break
            if a is b or not keep[b[2]] or a[1] != b[1] or inter(a, b) == 0:
                continue
            if area(b) < area(a):
                if inter(a, b) / area(b) > t:
                    keep[b[2]] = False
            elif inter(a, b) / area(a) > t:
                keep[a[2]] = False
    return {k for k, x in keep.items() if x}


@pytest.mark.parametrize("seed", range(4))
def test_suppressed_and_nested_equal_brute_force(spark, seed):
    rows = boxes(seed, 80)
    rows += [(*r[:2], 1000 + i, *r[3:]) for i, r in enumerate(rows[:10])]  # repeated rows under new ids
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.det_id for r in detect.suppressed(df).collect()}
    assert got == greedy(rows, 0.5)
    assert {r.det_id for r in detect.unnested(df).collect()} == {r.det_id for r in detect.unnested(df, fold=5).collect()} == nested(rows, 0.8)
    again = detect.suppressed(df.where(F.col("det_id").isin(list(got))))
    assert {r.det_id for r in again.collect()} == got


def test_nulls_and_empty(spark):
    rows = [("p", "f", 1, "a", 0.5, None, None, None, None, None, None), (None, None, 2, "a", 0.4, 0.0, 0.0, 1.0, 1.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.det_id for r in detect.suppressed(df).collect()} == {1, 2}
    none = df.limit(0)
    for f in (detect.suppressed, detect.unnested, detect.unnested_set, axes.plot_bounds, detect.dynamic_confidence):
        assert f(none).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0,), (99,), (None,)], "cls_id int")
    assert [r.l for r in df.select(detect.class_label().alias("l")).collect()] == ["data_point", "unknown_99", "unknown_none"]


def test_dynamic_confidence(spark):
    def count(n):
        return detect.dynamic_confidence(spark.createDataFrame([("p", "f", i, "a", 0.3 + 0.2 * (i % 2), *[0.0] * 6) for i in range(n)], SCHEMA)).count()

    assert (count(9), count(150), count(151)) == (9, 150, 75)


def test_tiles(spark):
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in detect.tile_grid(spark).collect())
    assert got == sorted([(0, 0, 640, 640), (360, 0, 1000, 640), (360, 0, 1000, 640), (0, 160, 640, 800), (360, 160, 1000, 800), (360, 160, 1000, 800)])


def test_route(spark):
    rows = [(500, 720, "x"), (500, 699, "x"), (90, 300, "yl"), (101, 300, "yl"), (450, 660, "x"), (450, 300, "yl"), (900, 300, "yr")]
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in rows], "cx double, cy double, want string")
    assert df.where(axes.route(F.col("cx"), F.col("cy"), F.lit(100.0), F.lit(700.0)) != F.col("want")).count() == 0


def test_fit_finds_the_line_beside_outliers(spark):
    rows = [("p", "f", "x", i, 10.0 * i, 700.0, str(i), 3.0 * i + 1) for i in range(1, 9)] + [("p", "f", "x", 50, 15.0, 700.0, "z", 9000.0)] + [("p", "g", "x", 60 + i, 5.0 * i, 1.0, "k", 1.0) for i in range(2)]
    c = spark.createDataFrame(rows, "paper_id string, figure_id string, axis string, det_id long, cx double, cy double, text string, value double")
    got = axes.fit(c, axes.log_votes(c)).collect()
    assert len(got) == 1 and got[0].inliers == 8
    assert got[0].slope == pytest.approx(0.3) and got[0].intercept == pytest.approx(1.0)


def test_nearest_value_equals_brute_force(spark):
    rows = boxes(9, 120, figures=2, spread=900)
    df = spark.createDataFrame(rows, SCHEMA)
    p, q = [r for r in rows if r[3] == "a"], [r for r in rows if r[3] == "b"]
    want = {}
    for a in p:
        near = [(((a[9] - b[9]) ** 2 + (a[10] - b[10]) ** 2) ** 0.5, b[2]) for b in q if b[1] == a[1]]
        near = [x for x in near if x[0] < 120]
        if near:
            want[a[2]] = min(near)[1]
    got = {r.det_id: r.value_id for r in series.nearest_value(df.where("label = 'a'"), df.where("label = 'b'")).collect()}
    assert got == want
