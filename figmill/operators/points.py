"""From detections to points in axis values.

Edge cases: figures without a model of the x axis give no points (see the pixel
fallback); a missing y model gives null; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from figmill.functions import values as v
from figmill.operators import axes, detect
from figmill.operators.detect import FIGURE, HEIGHT
from figmill.operators.series import nearest_value
from figmill.session import cut

VALUE_LABELS = ["data_value", "value_label", "point_value", "floating_value"]


def promoted(dets: DataFrame, bounds: DataFrame, dual: DataFrame, wanted: bool | DataFrame = True) -> DataFrame:
    """Labels inside the plot become data values where values are wanted and there is one vertical axis. ``wanted`` holds for
    all figures, or is a table (figure, heatmap) of those that want them."""
    j = dets.join(bounds.select(*FIGURE, "x_min", "y_max"), FIGURE, "left").join(dual, FIGURE, "left")
    if isinstance(wanted, DataFrame):
        j, asked = j.join(wanted.select(*FIGURE, "heatmap"), FIGURE, "left"), F.coalesce("heatmap", F.lit(False))
    else:
        asked = F.lit(wanted)
    inside = asked & ~F.coalesce("dual", F.lit(False)) & (F.col("x_min") > 0) & (F.col("y_max") < HEIGHT) & F.col("label").isin("tick_label", "text", "value") & (F.col("cx") > F.col("x_min") + 15) & (F.col("cy") < F.col("y_max") - 15)
    return j.withColumn("label", F.when(inside, "data_value").otherwise(F.col("label"))).select(*dets.columns)


def predicted(model: str, pixel: Column) -> Column:
    """The value of a pixel under a model struct (is_log, slope, intercept)."""
    y = F.col(f"{model}.slope") * pixel + F.col(f"{model}.intercept")
    return F.when(F.col(f"{model}.is_log"), F.pow(F.lit(10.0), y)).otherwise(y)


def cleaned(dets: DataFrame) -> DataFrame:
    """What is mapped of raw detections: overlaps suppressed, doubtful boxes of crowded figures and nested boxes dropped.

    The rows are written once, for the steps of the mapping read them several times."""
    fold = detect.FOLD if detect.has_crowded(dets) else None  # looked for once
    return cut(detect.unnested(detect.dynamic_confidence(detect.suppressed(dets, fold=fold)), fold=fold))


def mapped(dets: DataFrame, texts: DataFrame, series: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """series, x, y_left, y_right_or_value of every data point: the whole chain from (cleaned) detections to values.

    ``modes`` (figure, heatmap, log_x) says which figures are heatmaps: their y axes are linear and their labels inside the
    plot are values of points. The three models of a figure become one row, so points are joined once."""
    bounds, dual = axes.plot_bounds(dets), axes.dual_axis(dets)
    found = axes.models(axes.axis_candidates(dets, texts, bounds), modes)
    of = lambda a, what: F.first(F.when(F.col("axis") == a, what), ignorenulls=True)
    whole = F.when(F.col("slope").isNotNull(), F.struct("is_log", "slope", "intercept"))
    # one row per figure, written once: points read its models and its lines
    per = cut(found.groupBy(*FIGURE).agg(*(of(a, whole).alias(a) for a in ("x", "yl", "yr")), *(of(a, F.col("line")).alias(f"line_{a}") for a in ("yl", "yr"))))
    points = axes.without_ghosts(dets.where("label = 'data_point'"), per.select(*FIGURE, "line_yl", "line_yr"))
    boxes = promoted(dets, bounds, dual, modes) if modes is not None else dets
    values = boxes.where(F.col("label").isin(VALUE_LABELS)).join(texts.select("det_id", "text"), "det_id")
    labels = nearest_value(points, values).join(values.select(F.col("det_id").alias("value_id"), v.parse_val(F.col("text")).alias("label_value")), "value_id").select("det_id", "label_value")
    j = points.join(per.drop("line_yl", "line_yr"), FIGURE).where("x is not null").join(dual, FIGURE, "left").join(labels, "det_id", "left").join(series.select("det_id", "series"), "det_id", "left")
    right = F.when(F.col("dual") & F.col("yr").isNotNull(), predicted("yr", F.col("cy"))).otherwise(F.col("label_value"))
    return j.select(*FIGURE, "det_id", F.coalesce("series", F.lit("Default")).alias("series"), predicted("x", F.col("cx")).alias("x"), F.when(F.col("yl").isNotNull(), predicted("yl", F.col("cy"))).alias("y_left"), right.alias("y_right_or_value"))


def pixel_fallback(dets: DataFrame, done: DataFrame) -> DataFrame:
    """series, x_pixel, y_pixel, note: points of figures that have no mapped point."""
    pts = dets.where("label = 'data_point'").join(done.select(*FIGURE).distinct(), FIGURE, "left_anti")
    return pts.select(*FIGURE, "det_id", F.lit("Default").alias("series"), F.col("cx").alias("x_pixel"), F.col("cy").alias("y_pixel"), F.lit("CoordMapping Failed").alias("note"))
