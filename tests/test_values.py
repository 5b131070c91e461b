import pytest
from pyspark.sql import functions as F

from figmill.functions import values as v

PARSE = [
    ("50", 50.0), ("10", 10.0), ("100", 1.0), ("1000", 1.0), ("105", 100000.0), ("110", 110.0), ("2100", 21.0), ("10.5", 10.5), ("10^-2", 0.01), ("10-2", 0.01),
    ("10^10", 1010.0), ("0.105", 10000.0), ("Fig. 5", 0.5), ("Temp 25", None), ("Selectivity", None), ("", None), ("5f", 5.0), ("105d", 105.0), ("10^2 ", 100.0), ("-5", -5.0), ("1e3", 1000.0), (None, None),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_val(spark):
    assert column(spark, [a for a, _ in PARSE], v.parse_val) == [b for _, b in PARSE]


def test_parse_val_strict(spark):
    assert column(spark, ["100", "10^3", "10^{-2}", "x"], lambda c: v.parse_val(c, strict=True)) == [100.0, 1000.0, 0.01, None]


def test_log_target(spark):
    got = column(spark, [-2.0, 14.0, 15.0, 0.01, 0.0, -0.5, None], v.log_target, "double")
    assert got[:2] == [-2.0, 14.0] and got[2] == pytest.approx(1.17609, abs=1e-5) and got[3] == pytest.approx(-2.0) and got[4:] == [0.0, None, None]


def test_relevance(spark):
    texts = ["S e l e c t i v i t y (%)", "n a o t o e e e e", "hydrogen flow", "Conversion (%)", "Time (min)", "Pressure (MPa)"]
    assert column(spark, texts, v.is_relevant) == [True, True, True, True, False, False]


def test_evidence(spark):
    assert column(spark, ["a", "12.5", "1", "..", "12 5", "-5", "", None], v.is_evidence) == [False, False, False, True, True, True, False, None]


def test_replies(spark):
    assert column(spark, ['```json\n{"a": 1}\n```', "{}", "```\nx```"], v.clean_json) == ['{"a": 1}', "{}", "x"]
    assert column(spark, ["a---JSON_START---\n{}\n---JSON_END---b", "none", "---JSON_START---x"], v.sentinel) == ["{}", None, None]


def test_names(spark):
    assert column(spark, ["a_x_axis_title_0.png", "a_caption_1.png", "a_legend_0.png", "other.png"], v.crop_kind) == ["x_axis_title", "chart_text", "legend_text", None]
    assert column(spark, ["a.PNG", "b.webp", "c.jpg"], v.mime_type) == ["image/png", "image/webp", "image/jpeg"]
