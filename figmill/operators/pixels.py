"""Operators on pixels: which figures are heatmaps, and the colour of a marker.

Pixels are rows of an image seam: the keys of their image or crop, x, y (from 0), the image's w and h, and grey or r, g, b
(0 to 255). Aggregations combine before the shuffle, so an image may be spread over tasks.

Edge cases: null values are left out; an image without pixels has no row; a crop of one pixel has that pixel's colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Brightness over which a pixel is white, and the share of white below which a figure is a heatmap.
WHITE, LEAST_WHITE = 240, 0.6


def heatmaps(pixels: DataFrame, keys: list[str], white: float = WHITE, least: float = LEAST_WHITE) -> DataFrame:
    """keys, white, heatmap: the share of white pixels of each image, and whether it is too small for a plain plot."""
    share = F.avg((F.col("grey") > white).cast("double"))
    return pixels.groupBy(*keys).agg(share.alias("white")).select(*keys, "white", (F.col("white") < least).alias("heatmap"))


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """h (0 to 180), s and v (0 to 255) of a colour, as image libraries store them in bytes."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, 60.0 * (g - b) / span).when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    h = F.round(F.when(turn < 0, turn + 360.0).otherwise(turn) / 2.0)
    return [F.when(h >= 180, h - 180.0).otherwise(h).alias("h"), F.when(top == 0, 0.0).otherwise(F.round(255.0 * span / top)).alias("s"), top.alias("v")]


def weighted_colour(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h, s, v: the mean colour of each crop, its middle weighing most.

    The weight falls off as a bell curve whose width is w / 2.5 across and h / 2.5 down; the mean is taken of r, g and b, cut
    to whole numbers, and then turned into a hue."""

    def off(i: str, size: str) -> Column:  # pixels lie evenly from -size / 2 to size / 2
        n = F.col(size)
        return F.when(n > 1, F.col(i) * n / (n - 1) - n / 2.0).otherwise(-n / 2.0)

    def part(i: str, size: str) -> Column:
        sigma = F.col(size) / 2.5
        return off(i, size) * off(i, size) / (2.0 * sigma * sigma)

    weight = F.exp(-(part("x", "w") + part("y", "h")))
    rows = pixels.withColumn("weight_", weight).where("r is not null and g is not null and b is not null")
    mean = rows.groupBy(*keys).agg(*(F.floor(F.sum(F.col(c) * F.col("weight_")) / F.sum("weight_") + 1e-9).cast("double").alias(c) for c in "rgb"))
    return mean.select(*keys, *hsv(F.col("r"), F.col("g"), F.col("b")))
