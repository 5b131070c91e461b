"""Operators on axes: plot bounds from tick marks, tick labels to axes, and the fit of pixel to value.

Candidates are tick labels and other texts with a recorded text (recognition is a
seam: its output is a table). Median is the exact one throughout.

Edge cases: a figure without tick marks has the default bounds; fewer than three
usable labels give no model; null texts have no value; ties between bins go to the
bin whose first detection comes first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from figmill.functions import values as v
from figmill.operators.detect import FIGURE, HEIGHT, WIDTH
from figmill.session import cut

BIN, MARGIN = 20.0, 2.0


def _bins(marks: DataFrame, c: str) -> DataFrame:
    return marks.groupBy(*FIGURE, F.floor(F.col(c) / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median(c).alias("mid"), F.min("det_id").alias("first_id"))


def vertical_axes(marks: DataFrame, least: int = 2) -> DataFrame:
    """left, right: medians of the first and last column of at least ``least`` tick marks; right only if it is far enough off."""
    cols = _bins(marks, "cx").where(F.col("n") >= least).groupBy(*FIGURE).agg(F.min_by("mid", "bin").alias("left"), F.max_by("mid", "bin").alias("right"), F.count(F.lit(1)).alias("columns"))
    far = (F.col("columns") >= 2) & (F.col("right") - F.col("left") > WIDTH * 0.4)
    return cols.select(*FIGURE, "left", F.when(far, F.col("right")).alias("right"))


def plot_bounds(dets: DataFrame) -> DataFrame:
    """x_min, x_max, y_max, dual of every figure: left axis, right axis or image width, bottom axis or image height."""
    marks = dets.where("label = 'tick_mark'")
    rows = _bins(marks, "cy").groupBy(*FIGURE).agg(F.max_by(F.struct("mid", "n"), F.struct("n", -F.col("first_id"))).alias("b"))
    bottom = rows.where("b.n >= 2").select(*FIGURE, F.col("b.mid").alias("bottom"))
    figures = dets.select(*FIGURE).distinct()
    j = figures.join(vertical_axes(marks), FIGURE, "left").join(bottom, FIGURE, "left")
    return j.select(*FIGURE, F.coalesce("left", F.lit(0.0)).alias("x_min"), F.coalesce("right", F.lit(float(WIDTH))).alias("x_max"), F.coalesce("bottom", F.lit(float(HEIGHT))).alias("y_max"), F.col("right").isNotNull().alias("dual"))


def dual_axis(dets: DataFrame, least: int = 3) -> DataFrame:
    """dual: is there a second vertical axis, by columns of at least ``least`` tick marks?"""
    figures = dets.select(*FIGURE).distinct()
    return figures.join(vertical_axes(dets.where("label = 'tick_mark'"), least), FIGURE, "left").select(*FIGURE, F.col("right").isNotNull().alias("dual"))


def route(cx: Column, cy: Column, x_min: Column, y_max: Column) -> Column:
    """The axis of a label by its place: x, yl or yr."""
    return (
        F.when(cy > y_max - MARGIN, "x").when(cx < x_min + MARGIN, "yl").when(cy > HEIGHT * 0.8, "x").when(cx < WIDTH / 2.0, "yl").otherwise("yr")
    )


def axis_candidates(dets: DataFrame, texts: DataFrame, bounds: DataFrame) -> DataFrame:
    """axis, text, value of the labels that lie outside the plot (where its bounds are known) and read as a number."""
    labels = dets.where(~F.col("label").isin("data_point", "marker", "legend_marker")).join(texts.select("det_id", "text"), "det_id").join(bounds, FIGURE)
    known = (F.col("x_min") > 20) & (F.col("y_max") < HEIGHT - 20)
    outside = (F.col("cy") > F.col("y_max") - MARGIN) | (F.col("cx") < F.col("x_min") + MARGIN) | (F.col("dual") & (F.col("cx") > F.col("x_max") - MARGIN))
    kept = labels.where(~known | outside).withColumn("value", v.parse_val(F.col("text"))).where("value is not null")
    return kept.select(*FIGURE, "det_id", route(F.col("cx"), F.col("cy"), F.col("x_min"), F.col("y_max")).alias("axis"), "cx", "cy", "text", "value")


def aligned(cands: DataFrame) -> DataFrame:
    """Candidates near the lowest well-filled bin of their axis' cross coordinate; axes of under three stay as they are."""
    cross = F.when(F.col("axis") == "x", F.col("cy")).otherwise(F.col("cx"))
    keys = [*FIGURE, "axis"]
    c = cut(cands.withColumn("cross", cross))  # read three times below
    bins = c.groupBy(*keys, F.floor(F.col("cross") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median("cross").alias("mid"), F.min("det_id").alias("first_id"))
    tops = bins.groupBy(*keys).agg(F.max("n").alias("top"), F.sum("n").alias("all_n"), F.max_by("mid", F.struct("n", -F.col("first_id"))).alias("modal"))
    major = bins.join(tops, keys).where((F.col("n") >= F.greatest(F.lit(3.0), F.col("top") * 0.5))).groupBy(*keys).agg(F.min_by("mid", "bin").alias("major"))
    line = tops.join(major, keys, "left").select(*keys, "all_n", F.coalesce("major", "modal").alias("line"))
    return c.join(line, keys).where((F.col("all_n") < 3) | (F.abs(F.col("cross") - F.col("line")) < 30.0)).select(*cands.columns)


def candidates(dets: DataFrame, texts: DataFrame) -> DataFrame:
    """The aligned candidates of all axes, written once for the steps that follow."""
    return cut(aligned(axis_candidates(dets, texts, plot_bounds(dets))))


def log_votes(cands: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """is_log of each axis: at least two labels, over half of them written as powers.

    ``modes`` (figure, heatmap, log_x; at most one row for a figure) forces the y axes of a heatmap to be linear and a
    figure's x axis to be logarithmic."""
    votes = cands.groupBy(*FIGURE, "axis").agg(((F.count(F.lit(1)) >= 2) & (F.avg(v.is_log_text(F.col("text")).cast("double")) > 0.5)).alias("is_log"))
    if modes is None:
        return votes
    forced = F.when((F.col("axis") != "x") & F.coalesce("heatmap", F.lit(False)), F.lit(False)).when((F.col("axis") == "x") & F.coalesce("log_x", F.lit(False)), F.lit(True))
    return votes.join(modes, FIGURE, "left").select(*FIGURE, "axis", F.coalesce(forced, "is_log").alias("is_log"))


#: Pairs of labels tried as a line for each axis, and the residual in value units up to which a label agrees.
TRIALS, RESIDUAL = 100, 10.0
#: Of an axis with more pairs than trials, trial m takes the labels (m * a + b) modulo their number along the axis.
_STEP = ((7919, 13), (104729, 7))


def trial_pairs(n: Column) -> Column:
    """The pairs (i, j) of labels, by their place along an axis of n, that are tried: all of them, or TRIALS spread over all."""
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(TRIALS)) - 2), lambda i: F.transform(F.sequence(i + 1, F.least(n, F.lit(TRIALS)) - 1), lambda j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j")))))
    (a, b), (c, d) = _STEP
    some = F.transform(F.sequence(F.lit(0), F.lit(TRIALS - 1)), lambda m: F.struct(((m * a + b) % n).cast("long").alias("i"), ((m * c + d) % n).cast("long").alias("j")))
    return F.when(n * (n - 1) / 2 <= TRIALS, every).otherwise(F.array_distinct(some))


def fit(cands: DataFrame, votes: DataFrame) -> DataFrame:
    """axis, is_log, slope, intercept, inliers: a robust line through (pixel, target) of each axis.

    All pairs of labels are tried or, where there are more than TRIALS, so many that are spread over all, like the random
    trials they stand for but the same in every run; the line most labels agree with wins, of equal ones that of the
    first pair, and is fitted again to these labels. An axis on which no pair makes a line is fitted to all its labels by
    least squares (a level line where they share one pixel). Work is in proportion to the labels."""
    keys = [*FIGURE, "axis"]
    pixel = F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy"))
    pts = cands.join(votes, keys).withColumn("px", pixel).withColumn("t", F.when(F.col("is_log"), v.log_target(F.col("value"))).otherwise(F.col("value"))).where("t is not null")
    w = W.partitionBy(*keys).orderBy("px", "det_id")
    ranked = pts.select(*keys, "is_log", "det_id", "px", "t", (F.row_number().over(w) - 1).cast("long").alias("r"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("n")).where("n >= 3")
    ranked = cut(ranked)  # read several times below
    pairs = ranked.where("r = 0").select(*keys, F.explode(trial_pairs(F.col("n"))).alias("q")).select(*keys, "q.i", "q.j")
    end = lambda p: ranked.select(*keys, F.col("r").alias(p), F.col("det_id").alias(f"d_{p}"), F.col("px").alias(f"px_{p}"), F.col("t").alias(f"t_{p}"))
    ends = pairs.join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"]).where("px_i <> px_j")
    slope = F.try_divide(F.col("t_j") - F.col("t_i"), F.col("px_j") - F.col("px_i"))
    tried = ends.select(*keys, F.col("d_i").alias("i"), F.col("d_j").alias("j"), slope.alias("a"), (F.col("t_i") - slope * F.col("px_i")).alias("b"))
    agree = tried.join(ranked.select(*keys, "px", "t"), keys).where(F.abs(F.col("a") * F.col("px") + F.col("b") - F.col("t")) <= RESIDUAL)
    scores = agree.groupBy(*keys, "i", "j", "a", "b").agg(F.count(F.lit(1)).alias("hits"))
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("a", "b"), F.struct("hits", -F.col("i"), -F.col("j"))).alias("m"))
    near = F.col("m").isNull() | (F.abs(F.col("m.a") * F.col("px") + F.col("m.b") - F.col("t")) <= RESIDUAL)
    inl = ranked.join(best, keys, "left").where(near)
    return inl.groupBy(*keys).agg(F.first("is_log").alias("is_log"), F.coalesce(F.regr_slope("t", "px"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("t", "px"), F.avg("t")).alias("intercept"), F.count(F.lit(1)).alias("inliers"))


#: Labels of an axis up to which its model is worked out in one row; larger axes take the way of ``aligned``, ``log_votes`` and ``fit``.
FOLD = 1000
_MODEL = "struct<is_log: boolean, slope: double, intercept: double, inliers: long, line: double>"


def _near_line(cross: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which labels of an axis ``aligned`` keeps."""
    if len(cross) < 3:
        return np.ones(len(cross), bool)
    bins = np.floor(cross / BIN)
    names, index, n = np.unique(bins, return_inverse=True, return_counts=True)
    full = np.flatnonzero(n >= max(3.0, n.max() * 0.5))
    pick = full[0] if len(full) else min(np.flatnonzero(n == n.max()), key=lambda b: ids[index == b].min())
    return np.abs(cross - np.median(cross[index == pick])) < 30.0


def _line_of(px: np.ndarray, t: np.ndarray, ids: np.ndarray) -> tuple[float, float, int]:
    """slope, intercept, inliers as ``fit`` has them."""
    order = np.lexsort((ids, px))
    px, t, ids = px[order], t[order], ids[order]
    n, ((e, f), (g, h)) = len(px), _STEP
    chosen = [(i, j) for i in range(n) for j in range(i + 1, n)] if n * (n - 1) / 2 <= TRIALS else [((m * e + f) % n, (m * g + h) % n) for m in range(TRIALS)]
    pairs = [(int(ids[i]), int(ids[j]), px[i], t[i], (t[j] - t[i]) / (px[j] - px[i])) for i, j in chosen if px[j] != px[i]]
    near = np.ones(len(px), bool)
    if pairs:
        a = np.array([p[4] for p in pairs])
        b = np.array([p[3] - p[4] * p[2] for p in pairs])
        agree = np.abs(a[:, None] * px + b[:, None] - t) <= RESIDUAL
        hits = agree.sum(axis=1)
        near = agree[min(range(len(pairs)), key=lambda q: (-hits[q], pairs[q][0], pairs[q][1]))]
    x, y = px[near], t[near]
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread else 0.0
    return slope, float(y.mean() - slope * x.mean()), int(near.sum())


def _model_of(axis: str, force: bool | None, ids: np.ndarray, cx: np.ndarray, cy: np.ndarray, value: np.ndarray, power: np.ndarray) -> dict:
    kept = _near_line(cy if axis == "x" else cx, ids)
    ids, cx, cy, value, power = ids[kept], cx[kept], cy[kept], value[kept], power[kept]
    is_log = bool(force) if force is not None else len(ids) >= 2 and bool(power.mean() > 0.5)
    px, t, out = cx if axis == "x" else cy, value, {"is_log": is_log, "line": float(np.median(cx)) if len(cx) else None}
    if is_log:
        whole = (np.abs(value) < 15) & (value == np.floor(value))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(whole, value, np.where(value > 0, np.log10(value), np.nan))
        px, t, ids = px[~np.isnan(t)], t[~np.isnan(t)], ids[~np.isnan(t)]
    if len(t) >= 3:
        out["slope"], out["intercept"], out["inliers"] = _line_of(px, t, ids)
    return out


def models(cands: DataFrame, modes: DataFrame | None = None, fold: int = FOLD) -> DataFrame:
    """axis, is_log, slope, intercept, inliers, line of every axis with labels: alignment, vote and fit in one step. slope
    is null where an axis has no model; line is the median x of its aligned labels.

    The labels of an axis, a few, meet in one shuffle. Axes of over ``fold`` labels are first looked for and take the
    relational way, with the same result. ``modes`` is as in ``log_votes``."""
    keys = [*FIGURE, "axis"]
    cands = cut(cands)  # its groups are counted first
    large = cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).select(*(F.col(k).alias(f"{k}_") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    some = not large.isEmpty()
    small = cands.join(large, same, "left_anti") if some else cands

    @F.pandas_udf(_MODEL)
    def model(axis: pd.Series, force: pd.Series, ids: pd.Series, cx: pd.Series, cy: pd.Series, value: pd.Series, power: pd.Series) -> pd.DataFrame:
        rows = [_model_of(*x) for x in zip(axis, force, ids, cx, cy, value, power)]
        out = pd.DataFrame(rows, columns=["is_log", "slope", "intercept", "inliers", "line"], index=axis.index)
        return out.astype({"inliers": "Int64"})

    one = F.struct("det_id", "cx", "cy", "value", F.coalesce(v.is_log_text(F.col("text")), F.lit(False)).alias("power"))
    groups = small.groupBy(*keys).agg(F.collect_list(one).alias("labels"))
    forced = F.lit(None).cast("boolean")
    if modes is not None:
        groups = groups.join(modes, FIGURE, "left")
        forced = F.when((F.col("axis") != "x") & F.coalesce("heatmap", F.lit(False)), F.lit(False)).when((F.col("axis") == "x") & F.coalesce("log_x", F.lit(False)), F.lit(True))
    folded = groups.select(*keys, model("axis", forced, *(f"labels.{c}" for c in ("det_id", "cx", "cy", "value", "power"))).alias("m")).select(*keys, "m.*")
    if not some:
        return folded
    near = cut(aligned(cands.join(large, same, "left_semi")))
    lines = near.groupBy(*keys).agg(F.median("cx").alias("line"))
    votes = log_votes(near, modes)
    found = fit(near, votes).select(*keys, "slope", "intercept", "inliers")
    return folded.unionByName(votes.join(found, keys, "left").join(lines, keys).select(*folded.columns))


def axis_lines(cands: DataFrame) -> DataFrame:
    """line_yl, line_yr: median x of the labels of the vertical axes."""
    cx = lambda a: F.median(F.when(F.col("axis") == a, F.col("cx")))
    return cands.groupBy(*FIGURE).agg(cx("yl").alias("line_yl"), cx("yr").alias("line_yr"))


def without_ghosts(points: DataFrame, lines: DataFrame, near: float = 10.0) -> DataFrame:
    """Points that don't lie on a vertical axis; an axis at 0 doesn't count."""
    ghost = lambda c: F.coalesce((F.col(c) != 0) & (F.abs(F.col("cx") - F.col(c)) < near), F.lit(False))
    return points.join(lines, FIGURE, "left").where(~(ghost("line_yl") | ghost("line_yr"))).drop("line_yl", "line_yr")
