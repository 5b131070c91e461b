"""Box geometry as column expressions, and a join of overlapping boxes.

Boxes are four columns x1, y1, x2, y2; a prefix names the side of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def area(p: str = "") -> Column:
    return (col(p, "x2") - col(p, "x1")) * (col(p, "y2") - col(p, "y1"))


def intersection(a: str, b: str) -> Column:
    """Area that two boxes share, 0 where they don't meet."""
    w = F.least(col(a, "x2"), col(b, "x2")) - F.greatest(col(a, "x1"), col(b, "x1"))
    h = F.least(col(a, "y2"), col(b, "y2")) - F.greatest(col(a, "y1"), col(b, "y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return F.try_divide(i, area(a) + area(b) - i)


def coverage(a: str, b: str) -> Column:
    """Share of the smaller box that the other one covers."""
    return F.try_divide(intersection(a, b), F.least(area(a), area(b)))


def clamp(value: Column, low: float, high: float) -> Column:
    """An integer pixel within an image; fractions are cut off towards zero."""
    return F.greatest(F.lit(low).cast("int"), F.least(F.lit(high).cast("int"), value.cast("int")))


def scaled(names: Sequence[str], by: float) -> list[Column]:
    return [(F.col(n) * F.lit(by)).alias(n) for n in names]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def cells(p: str, size: float) -> Column:
    """Grid cells that a box covers, as structs gx, gy."""
    lo_x, hi_x = F.floor(col(p, "x1") / size), F.floor(col(p, "x2") / size)
    lo_y, hi_y = F.floor(col(p, "y1") / size), F.floor(col(p, "y2") / size)
    return F.flatten(F.transform(F.sequence(lo_x, F.greatest(lo_x, hi_x)), lambda x: F.transform(F.sequence(lo_y, F.greatest(lo_y, hi_y)), lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], size: float = 64.0) -> DataFrame:
    """Pairs of boxes (columns a_*, b_*) of the same keys that share a positive area, each pair once.

    Boxes meet on the cells of a grid, so a figure with many boxes is spread over
    its cells; of the cells two boxes share, the pair is kept in the first one only."""
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    a = a.where("a_x1 is not null and a_x2 is not null and a_y1 is not null and a_y2 is not null").withColumn("a_cell", F.explode(cells("a_", size)))
    b = b.where("b_x1 is not null and b_x2 is not null and b_y1 is not null and b_y2 is not null").withColumn("b_cell", F.explode(cells("b_", size)))
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [F.col("a_cell") == F.col("b_cell")]
    first = (F.col("a_cell.gx") == F.greatest(F.floor(F.col("a_x1") / size), F.floor(F.col("b_x1") / size))) & (F.col("a_cell.gy") == F.greatest(F.floor(F.col("a_y1") / size), F.floor(F.col("b_y1") / size)))
    return a.join(b, on).where(first & (intersection("a_", "b_") > 0)).drop("a_cell", "b_cell")
