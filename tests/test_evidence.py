from figmill.operators import evidence
from tests.test_units import packets


def captions(spark, *texts):
    return packets(spark, [(i, (f"page_{i % 2}_figure_{i}_t0", t), None, None, "z") for i, t in enumerate(texts)])


def test_caption_lines(spark):
    df = captions(spark, "noise\nFig. 2 Effect\nof flow\n(MPa)", "no starter", None, "", "Scheme 1")
    assert [r.caption for r in evidence.caption_lines(df).orderBy("packet_id").collect()] == ["Fig. 2 Effect of flow (MPa)", "", "", "", "Scheme 1"]


def test_terms(spark):
    df = spark.createDataFrame([("Yield of PhCl (%) at 25 C, r.t.",), ("N n H K 1.5 [ee]",), (None,), ("",)], "text string")
    assert sorted(r.term for r in evidence.terms(df).collect()) == ["N", "PhCl", "ee", "r.t"]


def test_nulls(spark):
    df = captions(spark, "a", None)
    assert evidence.points(df).count() == 0
    assert [(r.x_title, r.y_title) for r in evidence.axis_titles(df).collect()] == [("X-Axis", "Y-Axis")] * 2
    assert [r.relevant for r in evidence.relevance(df).collect()] == [False, False]
