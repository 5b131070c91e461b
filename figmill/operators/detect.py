"""Operators on detections: labels, thresholds, tiles and overlap suppression.

A detection has the key (paper_id, figure_id, det_id), a label, a confidence, a
box x1, y1, x2, y2 and a centre cx, cy. det_id is unique and orders detections.

Edge cases: a null label takes the label of its class, a null confidence counts
as 0 and a null coordinate keeps a row out of every overlap test (it is kept);
equal confidences are taken in the order of det_id; empty inputs give empty results.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from figmill.functions import geometry as g
from figmill.session import cut

FIGURE = ["paper_id", "figure_id"]
BOX = ["x1", "y1", "x2", "y2"]
#: Classes of the detection model.
MICRO_CLASSES = {0: "data_point", 1: "tick_label", 2: "tick_mark", 3: "marker", 4: "legend_marker", 5: "value_label", 6: "text"}
#: Size of the rendered plot image in pixels.
WIDTH, HEIGHT = 1000, 800


def class_label(cls: str = "cls_id", classes: dict[int, str] = MICRO_CLASSES):
    """The label of a class id; unknown_<id> where the id has none."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in classes.items()))
    return F.coalesce(F.try_element_at(table, F.col(cls)), F.concat(F.lit("unknown_"), F.coalesce(F.col(cls).cast("string"), F.lit("none"))))


def detections(micro: DataFrame) -> DataFrame:
    """Flat detections with labels and confidences filled."""
    return micro.select(*FIGURE, "det_id", "det_idx", F.coalesce("label", class_label()).alias("label"), "cls_id", F.coalesce("conf", F.lit(0.0)).alias("conf"), *(F.col(f"box.{c}").alias(c) for c in BOX), "cx", "cy")


def by_label(dets: DataFrame, labels: list[str], keep: bool = True) -> DataFrame:
    test = F.col("label").isin(labels)
    return dets.where(test if keep else ~test)


def confident(dets: DataFrame, at_least: float) -> DataFrame:
    return dets.where(F.col("conf") >= at_least)


def dynamic_confidence(dets: DataFrame, many: int = 150, at_least: float = 0.4) -> DataFrame:
    """In figures with over ``many`` detections only confident ones stay. Counts are joined, so a large figure isn't gathered in one task."""
    n = dets.groupBy(*FIGURE).agg(F.count(F.lit(1)).alias("figure_n"))
    return dets.join(n, FIGURE).where((F.col("figure_n") <= many) | (F.col("conf") >= at_least)).drop("figure_n")


def tile_grid(spark: SparkSession, width: int = WIDTH, height: int = HEIGHT, tile: int = 640, overlap: float = 0.25) -> DataFrame:
    """tile_no, x1, y1, x2, y2: tiles of one size; edge tiles are shifted back into the image, so some may coincide."""
    step = int(tile * (1 - overlap))
    one = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))).alias("y"))
    both = one.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step))).alias("x"))
    x2, y2 = F.least(F.col("x") + tile, F.lit(width)), F.least(F.col("y") + tile, F.lit(height))
    spans = both.select("x", "y", F.greatest(F.lit(0), x2 - tile).alias("x1"), F.greatest(F.lit(0), y2 - tile).alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return spans.withColumn("tile_no", (F.floor(F.col("y") / step) * F.lit(-(-width // step)) + F.floor(F.col("x") / step)).cast("int")).select("tile_no", *BOX)


def tile_to_image(dets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes found in tiles (with a column tile_no) in image coordinates."""
    t = tiles.select("tile_no", F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    moved = {c: F.col(c) + F.col("tx" if c[0] == "x" else "ty") for c in BOX}
    return dets.join(F.broadcast(t), "tile_no").withColumns(moved).drop("tx", "ty")


#: Boxes of a figure and label up to which they are folded in one row; larger groups are spread over a grid.
FOLD = 2000


def has_crowded(dets: DataFrame, fold: int = FOLD) -> bool:
    """Is there a figure of over ``fold`` boxes?"""
    return not dets.groupBy(*FIGURE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).isEmpty()


def suppressed(dets: DataFrame, threshold: float = 0.5, fold: int | None = FOLD) -> DataFrame:
    """Greedy suppression of overlaps within a label: the most confident box stays, boxes that overlap a kept one by
    an IoU over the threshold (or equal it) go.

    The boxes of a figure and label meet in one shuffle and are folded in the order of their confidence. Groups of over
    ``fold`` boxes are first looked for and take another way with the same result (``_suppressed_on_grid``); with None there
    are none, as the caller knows."""
    keys = [*FIGURE, "label"]
    if fold is None:
        return _folded(dets, keys, threshold)
    large = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).select(*(F.col(k).alias(f"{k}_") for k in keys))
    if large.isEmpty():
        return _folded(dets, keys, threshold)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return _folded(dets.join(large, same, "left_anti"), keys, threshold).unionByName(_suppressed_on_grid(dets.join(large, same, "left_semi"), threshold))


def _folded(dets: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    rest = [c for c in dets.columns if c not in (*keys, "conf", "det_id")]
    one = F.struct((-F.col("conf")).alias("order_"), "det_id", "conf", *rest)
    least, most = (lambda a, b, c: F.least(a[c], b[c])), (lambda a, b, c: F.greatest(a[c], b[c]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])

    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()

    def covers(k: Column, x: Column) -> Column:
        common = F.greatest(F.lit(0.0), least(k, x, "x2") - most(k, x, "x1")) * F.greatest(F.lit(0.0), least(k, x, "y2") - most(k, x, "y1"))
        equal = (k["x1"] == x["x1"]) & (k["y1"] == x["y1"]) & (k["x2"] == x["x2"]) & (k["y2"] == x["y2"])
        return F.coalesce(F.try_divide(common, area(k) + area(x) - common) > threshold, F.lit(False)) | F.coalesce(equal, F.lit(False))

    step = lambda kept, x: F.when(known & F.exists(kept, lambda k: covers(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    groups = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all_"))
    kept = groups.select(*keys, F.explode(F.reduce("all_", F.slice("all_", 1, 0), step)).alias("k_"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"k_.{c}").alias(c) for c in dets.columns))


def _suppressed_on_grid(dets: DataFrame, threshold: float) -> DataFrame:
    """Equal boxes are reduced to their best first. Overlapping pairs are found on a grid and resolved in rounds: a box
    stays once no undecided better box overlaps it. Rounds are as many as the longest chain of overlaps; no figure is
    gathered in one task. Each round is cut through the checkpoint folder."""
    keys = [*FIGURE, "label"]
    order = W.partitionBy(*keys, *BOX).orderBy(F.desc("conf"), "det_id")
    best = dets.withColumn("copy_no", F.row_number().over(order)).where((F.col("copy_no") == 1) | F.col("x1").isNull() | F.col("y1").isNull() | F.col("x2").isNull() | F.col("y2").isNull()).drop("copy_no")
    best = cut(best)
    slim = best.select(*keys, "det_id", "conf", *BOX)
    better = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_det_id") < F.col("b_det_id")))
    edges = cut(g.overlapping(slim, slim, keys).where(better & (g.iou("a_", "b_") > threshold)).select(F.col("a_det_id").alias("over"), F.col("b_det_id").alias("under")))
    gone = None
    open_ = edges
    while not open_.isEmpty():
        # boxes that no open edge leads to stay; what they overlap goes; edges of either are settled
        unders = open_.select(F.col("under").alias("u")).distinct()
        tagged = open_.join(unders, open_.over == unders.u, "left").select("over", "under", F.col("u").isNull().alias("free"))
        lost = tagged.where("free").select(F.col("under").alias("l")).distinct().withColumn("lost", F.lit(True))
        settled = tagged.join(lost, tagged.under == lost.l, "left").select("over", "under", "free", F.col("lost").isNotNull().alias("under_lost"))
        step = cut(settled.join(lost, settled.over == lost.l, "left").select("over", "under", "free", "under_lost", F.col("lost").isNotNull().alias("over_lost")))
        out = step.where("free").select(F.col("under").alias("det_id")).distinct()
        gone = out if gone is None else gone.unionByName(out)
        open_ = step.where("not free and not under_lost and not over_lost").select("over", "under")
    return best if gone is None else best.join(gone, "det_id", "left_anti").select(*best.columns)


def covered_pairs(dets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs of boxes of a figure of which one covers the smaller by more than a share; a is the earlier one."""
    slim = dets.select(*FIGURE, "det_id", *BOX)
    return g.overlapping(slim, slim, FIGURE).where((F.col("a_det_id") < F.col("b_det_id")) & (g.coverage("a_", "b_") > at_least))


def unnested_set(dets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Boxes that no other box of the figure covers: the smaller of a pair goes, of equal ones the earlier.

    Differs from the sequential rule only where the covering box is itself covered by a third."""
    p = covered_pairs(dets, at_least)
    goes = p.select(F.when(g.area("b_") < g.area("a_"), F.col("b_det_id")).otherwise(F.col("a_det_id")).alias("det_id")).distinct()
    return dets.join(goes, "det_id", "left_anti").select(*dets.columns)


def unnested(dets: DataFrame, at_least: float = 0.8, fold: int | None = FOLD) -> DataFrame:
    """The sequential rule: boxes are taken in the order of det_id, each drops the smaller ones it covers and goes itself if a
    kept box of its size or larger covers it.

    The boxes of a figure meet in one shuffle. Figures of over ``fold`` boxes are first looked for and take another way with
    the same result, in which only their covered pairs are gathered; with None there are none."""
    if fold is None:
        return _unnested_folded(dets, at_least)
    large = dets.groupBy(*FIGURE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).select(*(F.col(k).alias(f"{k}_") for k in FIGURE))
    if large.isEmpty():
        return _unnested_folded(dets, at_least)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in FIGURE]
    return _unnested_folded(dets.join(large, same, "left_anti"), at_least).unionByName(_unnested_by_pairs(dets.join(large, same, "left_semi"), at_least))


def _gone(firsts: np.ndarray, seconds: np.ndarray, signs: np.ndarray) -> list[int]:
    """What the sequential rule drops, from covered pairs and the sign of the second's area less the first's."""
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, s in zip(firsts.tolist(), seconds.tolist(), signs.tolist()):
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, -s))
    gone: set[int] = set()
    for i in sorted(near):
        if i in gone:
            continue
        for j, sign in sorted(near[i]):
            if j in gone:
                continue
            if sign < 0:
                gone.add(j)
            else:
                gone.add(i)
                break
    return sorted(gone)


def _unnested_folded(dets: DataFrame, at_least: float) -> DataFrame:
    @F.pandas_udf("array<long>")
    def dropped(ids: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        out = []
        for i, a, b, c, d in zip(ids, x1, y1, x2, y2):
            a, b, c, d = (np.asarray(x, dtype=float) for x in (a, b, c, d))
            area = (c - a) * (d - b)
            common = np.maximum(0, np.minimum.outer(c, c) - np.maximum.outer(a, a)) * np.maximum(0, np.minimum.outer(d, d) - np.maximum.outer(b, b))
            with np.errstate(divide="ignore", invalid="ignore"):
                first, second = np.nonzero(np.triu((common > 0) & (common / np.minimum.outer(area, area) > at_least), 1))
            out.append(_gone(i[first], i[second], np.sign(area[second] - area[first]).astype(int)) if len(first) else [])
        return pd.Series(out)

    rest = [c for c in dets.columns if c not in (*FIGURE, "det_id")]
    groups = dets.groupBy(*FIGURE).agg(F.collect_list(F.struct("det_id", *rest)).alias("all_"))
    known = F.col(FIGURE[0]).isNotNull() & F.col(FIGURE[1]).isNotNull()
    gone = F.when(known, dropped(*(f"all_.{c}" for c in ("det_id", *BOX))))
    kept = groups.withColumn("gone_", gone).select(*FIGURE, F.explode(F.filter("all_", lambda x: ~F.coalesce(F.array_contains("gone_", x["det_id"]), F.lit(False)))).alias("k_"))
    return kept.select(*(F.col(c) if c in FIGURE else F.col(f"k_.{c}").alias(c) for c in dets.columns))


def _unnested_by_pairs(dets: DataFrame, at_least: float) -> DataFrame:
    p = covered_pairs(dets, at_least).select(F.col("a_paper_id").alias("paper_id"), F.col("a_figure_id").alias("figure_id"), F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), F.signum(g.area("b_") - g.area("a_")).cast("int").alias("sign"))

    @F.pandas_udf("array<long>")
    def dropped(a: pd.Series, b: pd.Series, sign: pd.Series) -> pd.Series:
        return pd.Series([_gone(*x) for x in zip(a, b, sign)])

    per = p.groupBy(*FIGURE).agg(F.collect_list(F.struct("a", "b", "sign")).alias("pairs"))
    goes = per.select(F.explode(dropped("pairs.a", "pairs.b", "pairs.sign")).alias("det_id"))
    return dets.join(goes, "det_id", "left_anti").select(*dets.columns)
