"""Operators on series: nearest texts, prototype colours and nearest prototypes.

Nearest means the least distance; of equal distances the lower id wins. Colours are
columns h (0 to 180, a circle), s and v (0 to 255), as recorded by a colour seam.

Edge cases: marks without a text, points without a prototype or without a value box
in reach are left out (or kept with nulls where the docstring says so).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from figmill.functions.geometry import distance
from figmill.operators.detect import FIGURE

RADIUS = 120.0


def hue_distance(a: str, b: str) -> Column:
    """Weighted distance of two colours with a circular hue."""
    d = F.abs(F.col(f"{a}h") - F.col(f"{b}h"))
    hue = F.least(d, F.lit(180.0) - d) / 180.0
    return F.lit(4.0) * hue + F.lit(1.5) * F.abs(F.col(f"{a}s") - F.col(f"{b}s")) / 255.0 + F.lit(0.5) * F.abs(F.col(f"{a}v") - F.col(f"{b}v")) / 255.0


def marker_texts(dets: DataFrame, band: float = 64.0) -> DataFrame:
    """marker_id, text_id: the nearest text at the right of each legend marker (within three heights up or down).

    Both sides meet on the bands of a figure that three heights around them touch, not with all texts of the figure."""

    def side(label: str, p: str, id_: str) -> DataFrame:
        h, y = F.col("y2") - F.col("y1"), F.col("cy")
        bands = F.sequence(F.floor((y - 3 * h) / band), F.greatest(F.floor((y - 3 * h) / band), F.floor((y + 3 * h) / band)))
        return dets.where(F.col("label") == label).select(*FIGURE, F.col("det_id").alias(id_), F.col("cx").alias(f"{p}x"), y.alias(f"{p}y"), h.alias(f"{p}h"), F.explode(bands).alias("band_"))

    near = (F.col("tx") >= F.col("mx") - 10) & (F.abs(F.col("ty") - F.col("my")) <= 3 * F.greatest("th", "mh"))
    pairs = side("legend_marker", "m", "marker_id").join(side("text", "t", "text_id"), [*FIGURE, "band_"]).where(near)
    return pairs.groupBy(*FIGURE, "marker_id").agg(F.min_by("text_id", F.struct(distance(F.col("mx"), F.col("my"), F.col("tx"), F.col("ty")).alias("d"), "text_id")).alias("text_id"))


def prototypes(markers: DataFrame) -> DataFrame:
    """h, s, v, n: mean colour of each series over its legend markers (columns figure, series, h, s, v)."""
    return markers.groupBy(*FIGURE, "series").agg(*(F.avg(c).alias(c) for c in "hsv"), F.count(F.lit(1)).alias("n"))


def nearest_series(points: DataFrame, protos: DataFrame) -> DataFrame:
    """det_id, series: the prototype of its figure whose colour is nearest to each point's."""
    p = points.select(*FIGURE, "det_id", *(F.col(c).alias(f"p_{c}") for c in "hsv"))
    q = protos.select(*FIGURE, "series", *(F.col(c).alias(f"q_{c}") for c in "hsv"))
    return p.join(q, FIGURE).groupBy(*FIGURE, "det_id").agg(F.min_by("series", F.struct(hue_distance("p_", "q_").alias("d"), "series")).alias("series"))


def nearest_value(points: DataFrame, values: DataFrame, radius: float = RADIUS) -> DataFrame:
    """det_id, value_id: the nearest value box within a radius of each point.

    Both sides meet on a grid of the radius' width, value boxes in the nine cells around them, so a figure with many
    boxes is spread over its cells and only near pairs are made."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select(*FIGURE, "det_id", "cx", "cy", cell("cx").alias("gx"), cell("cy").alias("gy"))
    around = F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda a: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda b: F.struct((cell("cx") + a).alias("gx"), (cell("cy") + b).alias("gy")))))
    q = values.select(*FIGURE, F.col("det_id").alias("value_id"), F.col("cx").alias("vx"), F.col("cy").alias("vy"), F.explode(around).alias("c")).select("*", "c.gx", "c.gy").drop("c")
    d = distance(F.col("cx"), F.col("cy"), F.col("vx"), F.col("vy"))
    return p.join(q, [*FIGURE, "gx", "gy"]).withColumn("d", d).where(F.col("d") < radius).groupBy(*FIGURE, "det_id").agg(F.min_by("value_id", F.struct("d", "value_id")).alias("value_id"))
