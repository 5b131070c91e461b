"""Queries over detections: geometry, suppression, axes, series and mapped points, each with reference SQL.

Recognised texts and colours are recorded outputs of a seam; here they are functions
of a detection's id and place that both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.functions import geometry as g, values as v
from figmill.operators import axes, detect, pixels, points, series
from figmill.operators.detect import BOX, FIGURE
from figmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CLASS_CASE = "CASE cls_id " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in detect.MICRO_CLASSES.items()) + " ELSE 'unknown_' || coalesce(CAST(cls_id AS VARCHAR), 'none') END"
DET = f"det AS (SELECT paper_id, figure_id, det_id, det_idx, coalesce(label, {_CLASS_CASE}) AS label, cls_id, coalesce(conf, 0.0) AS conf, box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2, cx, cy FROM micro_detections)"
TXT = "txt AS (SELECT det_id, CASE WHEN det_id % 11 = 0 THEN 'Fig. ' || CAST(det_id % 9 AS VARCHAR) WHEN det_id % 13 = 0 THEN '10^' || CAST(det_id % 5 AS VARCHAR) ELSE CAST(CAST(floor((cx + 800 - cy) / 10) AS BIGINT) AS VARCHAR) END AS text FROM det WHERE label IN ('tick_label', 'text', 'value_label'))"
HSV = "CAST(det_id * 37 % 180 AS DOUBLE) AS h, CAST(det_id * 53 % 256 AS DOUBLE) AS s, CAST(det_id * 71 % 256 AS DOUBLE) AS v"


def _float(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim({x}) AS DOUBLE) END"


def _parse(t: str) -> str:
    powered, cleaned = f"replace(replace({t}, '10^', '1e'), '10', '1e')", f"regexp_replace({t}, '[^0-9.\\-eE]', '', 'g')"
    return f"coalesce(CASE WHEN contains({t}, '10') AND contains({powered}, '1e') THEN {_float(powered)} END, {_float(cleaned)})"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def dets(spark: SparkSession, d: str) -> DataFrame:
    return detect.detections(table(spark, d, "micro_detections"))


def texts(x: DataFrame) -> DataFrame:
    """The recorded recognised texts."""
    i = F.col("det_id")
    plain = F.floor((F.col("cx") + 800 - F.col("cy")) / 10).cast("string")
    return x.where("label in ('tick_label', 'text', 'value_label')").select("det_id", F.when(i % 11 == 0, F.concat(F.lit("Fig. "), (i % 9).cast("string"))).when(i % 13 == 0, F.concat(F.lit("10^"), (i % 5).cast("string"))).otherwise(plain).alias("text"))


def coloured(x: DataFrame) -> DataFrame:
    """The recorded colours."""
    i = F.col("det_id")
    return x.withColumns({"h": (i * 37 % 180).cast("double"), "s": (i * 53 % 256).cast("double"), "v": (i * 71 % 256).cast("double")})


def recorded_pixels(x: DataFrame) -> DataFrame:
    """The recorded pixels: one at the centre of each detection."""
    i, whole = F.col("det_id"), lambda c: F.floor(c).cast("double")
    return x.select(*FIGURE, whole("cx").alias("x"), whole("cy").alias("y"), F.lit(1000.0).alias("w"), F.lit(800.0).alias("h"), F.least(F.lit(255.0), (i * 53 % 256) * 2.5).alias("grey"), *((i * k % 256).cast("double").alias(c) for k, c in ((37, "r"), (53, "g"), (71, "b"))))


# --- projections -------------------------------------------------------------


@query(f"WITH {DET} SELECT det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det")
def det_centers(spark, d):
    return dets(spark, d).select("det_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))


@query(f"WITH {DET} SELECT det_id, x1 * 1.5 AS x1, y1 * 1.5 AS y1, x2 * 1.5 AS x2, y2 * 1.5 AS y2 FROM det")
def box_scale(spark, d):
    return dets(spark, d).select("det_id", *g.scaled(BOX, 1.5))


@query(f"WITH {DET} SELECT det_id, round(x1 + 0.001, 2) AS x1, round(y2 / 4 + 0.001, 2) AS y2 FROM det")
def box_round(spark, d):
    return dets(spark, d).select("det_id", F.round(F.col("x1") + 0.001, 2).alias("x1"), F.round(F.col("y2") / 4 + 0.001, 2).alias("y2"))


_TRUNC = "CAST(trunc({}) AS INTEGER)"


@query(f"WITH {DET} SELECT det_id, greatest(0, least(900, {_TRUNC.format('x1')})) AS x1, greatest(0, least(700, {_TRUNC.format('y1')})) AS y1, greatest(0, least(900, {_TRUNC.format('x2')})) AS x2, greatest(0, least(700, {_TRUNC.format('y2')})) AS y2 FROM det")
def box_clamp(spark, d):
    return dets(spark, d).select("det_id", *(g.clamp(F.col(c), 0, 900 if c[0] == "x" else 700).alias(c) for c in BOX))


@query(f"WITH {DET} SELECT det_id, greatest(0, {_TRUNC.format('x1')} - 12) AS ax1, least(1000, {_TRUNC.format('x2')} + 12) AS ax2, greatest(0, {_TRUNC.format('y1')} - 14) AS vy1, least(800, {_TRUNC.format('y2')} + 14) AS vy2, x1 + greatest(1, {_TRUNC.format('(x2 - x1) * 0.2')}) AS lx1, x2 - greatest(1, {_TRUNC.format('(x2 - x1) * 0.2')}) AS lx2, x1 - greatest(1, {_TRUNC.format('(x2 - x1) * 0.1')}) AS px1, x1 + 30 AS bx1 FROM det")
def box_pad(spark, d):
    i = lambda c: F.col(c).cast("int")
    share = lambda r: F.greatest(F.lit(1), ((F.col("x2") - F.col("x1")) * r).cast("int"))
    return dets(spark, d).select(
        "det_id", F.greatest(F.lit(0), i("x1") - 12).alias("ax1"), F.least(F.lit(1000), i("x2") + 12).alias("ax2"), F.greatest(F.lit(0), i("y1") - 14).alias("vy1"), F.least(F.lit(800), i("y2") + 14).alias("vy2"),
        (F.col("x1") + share(0.2)).alias("lx1"), (F.col("x2") - share(0.2)).alias("lx2"), (F.col("x1") - share(0.1)).alias("px1"), (F.col("x1") + 30).alias("bx1"),
    )


@query(
    """SELECT CAST((y // 480) * 3 + x // 480 AS INTEGER) AS tile_no, greatest(0, least(x + 640, 1000) - 640) AS x1, greatest(0, least(y + 640, 800) - 640) AS y1, least(x + 640, 1000) AS x2, least(y + 640, 800) AS y2
    FROM (SELECT CAST(unnest(range(0, 800, 480)) AS INTEGER) AS y), (SELECT CAST(unnest(range(0, 1000, 480)) AS INTEGER) AS x)"""
)
def tile_grid(spark, d):
    return detect.tile_grid(spark)


@query(
    f"""WITH {DET}, t AS (SELECT CAST((y // 480) * 3 + x // 480 AS INTEGER) AS tile_no, greatest(0, least(x + 640, 1000) - 640) AS tx, greatest(0, least(y + 640, 800) - 640) AS ty
    FROM (SELECT CAST(unnest(range(0, 800, 480)) AS INTEGER) AS y), (SELECT CAST(unnest(range(0, 1000, 480)) AS INTEGER) AS x))
    SELECT det_id, x1 + tx AS x1, y1 + ty AS y1, x2 + tx AS x2, y2 + ty AS y2 FROM det JOIN t ON tile_no = det_id % 6"""
)
def tile_remap(spark, d):
    local = dets(spark, d).withColumn("tile_no", (F.col("det_id") % 6).cast("int"))
    return detect.tile_to_image(local, detect.tile_grid(spark)).select("det_id", *BOX)


@query(f"SELECT det_id, {_CLASS_CASE} AS label FROM micro_detections")
def class_map(spark, d):
    return table(spark, d, "micro_detections").select("det_id", detect.class_label().alias("label"))


# --- filters, limits, unions -------------------------------------------------


@query(f"WITH {DET} SELECT 0 AS part, det_id, label FROM det WHERE label NOT IN ('data_point', 'marker') UNION ALL SELECT 1, det_id, label FROM det WHERE label IN ('data_point', 'marker')")
def label_split(spark, d):
    x, kinds = dets(spark, d), ["data_point", "marker"]
    one = lambda part, keep: detect.by_label(x, kinds, keep).select(F.lit(part).alias("part"), "det_id", "label")
    return one(0, False).unionByName(one(1, True))


@query(f"WITH {DET} SELECT det_id, conf FROM det WHERE conf >= 0.4")
def conf_filter(spark, d):
    return detect.confident(dets(spark, d), 0.4).select("det_id", "conf")


@query(f"WITH {DET} SELECT label, count(*) AS n, count(DISTINCT cls_id) AS classes FROM det GROUP BY label")
def label_hist(spark, d):
    return dets(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cls_id").alias("classes"))


@query(f"WITH {DET} SELECT det_id, conf FROM det WHERE label = 'data_point' ORDER BY conf DESC, det_id LIMIT 3")
def topk_conf(spark, d):
    return dets(spark, d).where("label = 'data_point'").orderBy(F.desc("conf"), "det_id").limit(3).select("det_id", "conf")


@query("SELECT det_id FROM micro_detections ORDER BY det_id * 7919 % 10007, det_id LIMIT 50")
def limit_n(spark, d):
    return table(spark, d, "micro_detections").orderBy(F.col("det_id") * 7919 % 10007, "det_id").limit(50).select("det_id")


@query(f"WITH {DET} SELECT 'points' AS source, det_id, label FROM det WHERE label = 'data_point' UNION ALL SELECT 'rest', det_id, label FROM det WHERE label <> 'data_point'")
def det_union(spark, d):
    """The outputs of two passes, which together cover all detections."""
    x, source = dets(spark, d), lambda s: F.lit(s).alias("source")
    return x.where("label = 'data_point'").select(source("points"), "det_id", "label").unionByName(x.where("label <> 'data_point'").select(source("rest"), "det_id", "label"))


@query(f"WITH {DET} SELECT det_id, (x2 - x1) AS w, (y2 - y1) AS h FROM det WHERE x2 - x1 >= 10 AND y2 - y1 >= 10")
def tiny_filter(spark, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return dets(spark, d).where((w >= 10) & (h >= 10)).select("det_id", w.alias("w"), h.alias("h"))


@query(f"WITH {DET}, n AS (SELECT *, count(*) OVER (PARTITION BY paper_id, figure_id) AS n FROM det) SELECT det_id FROM n WHERE n <= 50 OR conf >= 0.4")
def dynamic_conf(spark, d):
    return detect.dynamic_confidence(dets(spark, d), 50).select("det_id")


_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(
    f"""WITH {DET} SELECT a.det_id FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE a.paper_id = b.paper_id AND a.figure_id = b.figure_id AND a.det_id <> b.det_id
    AND {_IOU} > 0 AND {_IOU} / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.8
    AND ((a.x2 - a.x1) * (a.y2 - a.y1) < (b.x2 - b.x1) * (b.y2 - b.y1) OR ((a.x2 - a.x1) * (a.y2 - a.y1) = (b.x2 - b.x1) * (b.y2 - b.y1) AND a.det_id < b.det_id)))"""
)
def nested_filter_set(spark, d):
    return detect.unnested_set(dets(spark, d)).select("det_id")


_NMS = """r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id, label ORDER BY conf DESC, det_id) AS k FROM det),
    s AS (SELECT paper_id, figure_id, label, k, [{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM r WHERE k = 1
      UNION ALL SELECT s.paper_id, s.figure_id, s.label, r.k, CASE WHEN len(list_filter(s.kept, lambda b: greatest(0, least(r.x2, b.x2) - greatest(r.x1, b.x1)) * greatest(0, least(r.y2, b.y2) - greatest(r.y1, b.y1))
        / ((r.x2 - r.x1) * (r.y2 - r.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(r.x2, b.x2) - greatest(r.x1, b.x1)) * greatest(0, least(r.y2, b.y2) - greatest(r.y1, b.y1))) > 0.5)) > 0 THEN s.kept
        ELSE list_append(s.kept, {'det_id': r.det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) END
      FROM s JOIN r ON r.paper_id = s.paper_id AND r.figure_id = s.figure_id AND r.label = s.label AND r.k = s.k + 1),
    nm AS (SELECT unnest(kept).det_id AS det_id FROM (SELECT kept FROM s QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id, label ORDER BY k DESC) = 1))"""


@query(f"WITH RECURSIVE {DET}, {_NMS} SELECT det_id FROM nm")
def nms(spark, d):
    return detect.suppressed(dets(spark, d)).select("det_id")


#: The sequential rule: what each box covers or is covered by, then one step per box; gone_ holds what is dropped so far.
_NEST = """nb AS (SELECT a.paper_id, a.figure_id, a.det_id AS i, list({{'j': b.det_id, 's': (b.x2 - b.x1) * (b.y2 - b.y1) < (a.x2 - a.x1) * (a.y2 - a.y1)}}) AS near FROM {src} a JOIN {src} b ON a.paper_id = b.paper_id AND a.figure_id = b.figure_id AND a.det_id <> b.det_id
      WHERE {iou} > 0 AND {iou} / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.8 GROUP BY ALL),
    nk AS (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY i) AS k FROM nb),
    n0 AS (SELECT paper_id, figure_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone_ FROM nk WHERE k = 1
      UNION ALL SELECT n0.paper_id, n0.figure_id, nk.k, CASE WHEN list_contains(gone_, nk.i) THEN gone_ ELSE
        gone_ || list_transform(list_filter(nk.near, lambda x: x.s AND x.j < coalesce(list_min(list_transform(list_filter(nk.near, lambda y: NOT y.s AND NOT list_contains(gone_, y.j)), lambda y: y.j)), 9223372036854775807)), lambda x: x.j)
        || CASE WHEN len(list_filter(nk.near, lambda y: NOT y.s AND NOT list_contains(gone_, y.j))) > 0 THEN [nk.i] ELSE CAST([] AS BIGINT[]) END END
      FROM n0 JOIN nk ON nk.paper_id = n0.paper_id AND nk.figure_id = n0.figure_id AND nk.k = n0.k + 1),
    gone AS (SELECT unnest(gone_) AS det_id FROM (SELECT gone_ FROM n0 QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY k DESC) = 1))"""


@query(f"WITH RECURSIVE {DET}, {_NEST.format(src='det', iou=_IOU)} SELECT det_id FROM det WHERE det_id NOT IN (SELECT det_id FROM gone)")
def nested_filter(spark, d):
    return detect.unnested(dets(spark, d)).select("det_id")


# --- axes ---------------------------------------------------------------------

_BOUNDS = """marks AS (SELECT * FROM det WHERE label = 'tick_mark'),
    xb AS (SELECT paper_id, figure_id, floor(cx / 20.0) AS bin, count(*) AS n, median(cx) AS mid FROM marks GROUP BY ALL),
    yb AS (SELECT paper_id, figure_id, floor(cy / 20.0) AS bin, count(*) AS n, median(cy) AS mid, min(det_id) AS f FROM marks GROUP BY paper_id, figure_id, floor(cy / 20.0)),
    va AS (SELECT paper_id, figure_id, arg_min(mid, bin) AS l, arg_max(mid, bin) AS r, count(*) AS c FROM xb WHERE n >= {least} GROUP BY ALL),
    ba AS (SELECT paper_id, figure_id, mid FROM yb QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY n DESC, f) = 1 AND n >= 2),
    figs AS (SELECT DISTINCT paper_id, figure_id FROM det),
    bounds AS (SELECT paper_id, figure_id, coalesce(l, 0.0) AS x_min, CASE WHEN c >= 2 AND r - l > 400 THEN r ELSE 1000.0 END AS x_max, coalesce(mid, 800.0) AS y_max, coalesce(c >= 2 AND r - l > 400, false) AS dual
      FROM figs LEFT JOIN va USING (paper_id, figure_id) LEFT JOIN ba USING (paper_id, figure_id))"""
_B2, _B3 = _BOUNDS.format(least=2), _BOUNDS.format(least=3)
_R = "CASE WHEN cy > y_max - 2 THEN 'x' WHEN cx < x_min + 2 THEN 'yl' WHEN cy > 640 THEN 'x' WHEN cx < 500 THEN 'yl' ELSE 'yr' END"
_CAND = f"""cand AS (SELECT * FROM (SELECT paper_id, figure_id, det_id, {_R} AS axis, cx, cy, text, {_parse("text")} AS val, x_min, x_max, y_max, dual FROM det JOIN txt USING (det_id) JOIN bounds USING (paper_id, figure_id) WHERE label NOT IN ('data_point', 'marker', 'legend_marker'))
    WHERE val IS NOT NULL AND (NOT (x_min > 20 AND y_max < 780) OR cy > y_max - 2 OR cx < x_min + 2 OR (dual AND cx > x_max - 2)))"""
_ALIGN = """cr AS (SELECT *, CASE WHEN axis = 'x' THEN cy ELSE cx END AS cross_ FROM cand),
    ab AS (SELECT paper_id, figure_id, axis, floor(cross_ / 20.0) AS bin, count(*) AS n, median(cross_) AS mid, min(det_id) AS f FROM cr GROUP BY paper_id, figure_id, axis, floor(cross_ / 20.0)),
    tops AS (SELECT paper_id, figure_id, axis, max(n) AS top, sum(n) AS all_n FROM ab GROUP BY ALL),
    modal AS (SELECT paper_id, figure_id, axis, mid FROM ab QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id, axis ORDER BY n DESC, f) = 1),
    major AS (SELECT paper_id, figure_id, axis, arg_min(mid, bin) AS mm FROM ab JOIN tops USING (paper_id, figure_id, axis) WHERE n >= greatest(3.0, top * 0.5) GROUP BY ALL),
    al AS (SELECT cr.* FROM cr JOIN tops USING (paper_id, figure_id, axis) JOIN modal USING (paper_id, figure_id, axis) LEFT JOIN major USING (paper_id, figure_id, axis) WHERE all_n < 3 OR abs(cross_ - coalesce(mm, mid)) < 30.0)"""
_VOTE = "vote AS (SELECT paper_id, figure_id, axis, count(*) >= 2 AND avg(CASE WHEN starts_with(trim(text), '10') OR contains(text, 'e') THEN 1.0 ELSE 0.0 END) > 0.5 AS is_log FROM al GROUP BY ALL)"
_TARGET = "CASE WHEN is_log THEN CASE WHEN abs(val) < 15 AND val = floor(val) THEN val WHEN val > 0 THEN log10(val) END ELSE val END"
_FIT = f"""pt0 AS (SELECT al.paper_id, al.figure_id, al.axis, det_id, is_log, CASE WHEN al.axis = 'x' THEN cx ELSE cy END AS px, {_TARGET} AS t FROM al JOIN vote USING (paper_id, figure_id, axis)),
    pt AS (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id, axis ORDER BY px, det_id) AS k, count(*) OVER (PARTITION BY paper_id, figure_id, axis) AS n FROM pt0 WHERE t IS NOT NULL),
    pq AS (SELECT paper_id, figure_id, axis, unnest(CASE WHEN n * (n - 1) / 2 <= 100 THEN flatten(list_transform(range(0, n), lambda i: list_transform(range(i + 1, n), lambda j: {{'i': i, 'j': j}}))) ELSE list_distinct(list_transform(range(0, 100), lambda m: {{'i': (m * 7919 + 13) % n, 'j': (m * 104729 + 7) % n}})) END) AS q FROM pt WHERE n >= 3 AND k = 1),
    tr AS (SELECT a.paper_id, a.figure_id, a.axis, a.det_id AS i, b.det_id AS j, (b.t - a.t) / (b.px - a.px) AS sl, a.t - (b.t - a.t) / (b.px - a.px) * a.px AS ic FROM pq JOIN pt a ON a.paper_id = pq.paper_id AND a.figure_id = pq.figure_id AND a.axis = pq.axis AND a.k = pq.q.i + 1
      JOIN pt b ON b.paper_id = pq.paper_id AND b.figure_id = pq.figure_id AND b.axis = pq.axis AND b.k = pq.q.j + 1 WHERE a.px <> b.px),
    sc AS (SELECT tr.paper_id, tr.figure_id, tr.axis, i, j, sl, ic, count(*) AS hits FROM tr JOIN pt ON tr.paper_id = pt.paper_id AND tr.figure_id = pt.figure_id AND tr.axis = pt.axis WHERE abs(sl * px + ic - t) <= 10.0 GROUP BY ALL),
    be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id, axis ORDER BY hits DESC, i, j) = 1),
    model AS (SELECT pt.paper_id, pt.figure_id, pt.axis, bool_or(is_log) AS is_log, coalesce(regr_slope(t, px), 0.0) AS slope, coalesce(regr_intercept(t, px), avg(t)) AS intercept, count(*) AS inliers FROM pt LEFT JOIN be ON pt.paper_id = be.paper_id AND pt.figure_id = be.figure_id AND pt.axis = be.axis WHERE pt.n >= 3 AND (sl IS NULL OR abs(sl * px + ic - t) <= 10.0) GROUP BY ALL)"""
_LINES = "lines AS (SELECT paper_id, figure_id, median(cx) FILTER (axis = 'yl') AS line_yl, median(cx) FILTER (axis = 'yr') AS line_yr FROM al GROUP BY ALL)"


def _axis(spark, d):
    x = dets(spark, d)
    return x, axes.axis_candidates(x, texts(x), axes.plot_bounds(x))


@query(f"WITH {DET}, {_B2} SELECT paper_id, figure_id, x_min, x_max, y_max, dual FROM bounds")
def plot_bounds(spark, d):
    return axes.plot_bounds(dets(spark, d))


@query(f"WITH {DET}, {_B3} SELECT paper_id, figure_id, dual FROM bounds")
def dual_axis(spark, d):
    return axes.dual_axis(dets(spark, d))


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND} SELECT det_id, axis, text, val AS value FROM cand")
def axis_candidates(spark, d):
    return _axis(spark, d)[1].select("det_id", "axis", "text", "value")


@query(f"WITH {DET}, {_B2} SELECT det_id, {_R} AS axis FROM det JOIN bounds USING (paper_id, figure_id)")
def axis_route(spark, d):
    x = dets(spark, d)
    return x.join(axes.plot_bounds(x), FIGURE).select("det_id", axes.route(F.col("cx"), F.col("cy"), F.col("x_min"), F.col("y_max")).alias("axis"))


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND}, {_ALIGN} SELECT det_id, axis FROM al")
def axis_align(spark, d):
    return axes.aligned(_axis(spark, d)[1]).select("det_id", "axis")


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND}, {_ALIGN}, {_LINES} SELECT * FROM lines")
def axis_medians(spark, d):
    x = dets(spark, d)
    return axes.axis_lines(axes.candidates(x, texts(x)))


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND}, {_ALIGN}, {_VOTE} SELECT * FROM vote")
def log_vote(spark, d):
    return axes.log_votes(axes.aligned(_axis(spark, d)[1]))


@query(f"WITH {DET}, {TXT} SELECT det_id, text, {_parse('text')} AS value FROM txt")
def parse_val(spark, d):
    x = dets(spark, d)
    return texts(x).select("det_id", "text", v.parse_val(F.col("text")).alias("value"))


@query(f"WITH {DET}, {TXT}, p AS (SELECT det_id, {_parse('text')} AS val, true AS is_log FROM txt) SELECT det_id, round({_TARGET}, 6) AS target FROM p WHERE {_TARGET} IS NOT NULL")
def log_target(spark, d):
    x = dets(spark, d)
    return texts(x).select("det_id", F.round(v.log_target(v.parse_val(F.col("text"))), 6).alias("target")).where("target is not null")


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND}, {_ALIGN}, {_VOTE}, {_FIT} SELECT paper_id, figure_id, axis, is_log, round(slope, 4) AS slope, round(intercept, 3) AS intercept, inliers FROM model WHERE slope IS NOT NULL")
def axis_fit(spark, d):
    x = dets(spark, d)
    return axes.models(axes.axis_candidates(x, texts(x), axes.plot_bounds(x))).where("slope is not null").select(*FIGURE, "axis", "is_log", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "inliers")


_GHOST = "NOT (coalesce(line_yl <> 0 AND abs(cx - line_yl) < 10, false) OR coalesce(line_yr <> 0 AND abs(cx - line_yr) < 10, false))"


@query(f"WITH {DET}, {TXT}, {_B2}, {_CAND}, {_ALIGN}, {_LINES} SELECT det_id FROM det LEFT JOIN lines USING (paper_id, figure_id) WHERE label = 'data_point' AND {_GHOST}")
def ghost_filter(spark, d):
    x, c = _axis(spark, d)
    return axes.without_ghosts(x.where("label = 'data_point'"), axes.axis_lines(axes.aligned(c))).select("det_id")


@query(
    f"""WITH {DET}, {_B2}, d3 AS (SELECT paper_id, figure_id, c >= 2 AND r - l > 400 AS dual3 FROM (SELECT paper_id, figure_id, arg_min(mid, bin) AS l, arg_max(mid, bin) AS r, count(*) AS c FROM xb WHERE n >= 3 GROUP BY ALL))
    SELECT det_id, CASE WHEN NOT coalesce(dual3, false) AND x_min > 0 AND y_max < 800 AND label IN ('tick_label', 'text', 'value') AND cx > x_min + 15 AND cy < y_max - 15 THEN 'data_value' ELSE label END AS label
    FROM det JOIN bounds USING (paper_id, figure_id) LEFT JOIN d3 USING (paper_id, figure_id)"""
)
def promote_values(spark, d):
    x = dets(spark, d)
    return points.promoted(x, axes.plot_bounds(x), axes.dual_axis(x)).select("det_id", "label")


# --- series and points ---------------------------------------------------------

_MT = """mt AS (SELECT m.paper_id, m.figure_id, m.det_id AS marker_id, arg_min(t.det_id, {'d': sqrt((m.cx - t.cx) * (m.cx - t.cx) + (m.cy - t.cy) * (m.cy - t.cy)), 'i': t.det_id}) AS text_id
    FROM det m JOIN det t ON m.paper_id = t.paper_id AND m.figure_id = t.figure_id AND m.label = 'legend_marker' AND t.label = 'text' WHERE t.cx >= m.cx - 10 AND abs(t.cy - m.cy) <= 3 * greatest(t.y2 - t.y1, m.y2 - m.y1) GROUP BY ALL)"""
_PR = f"pr AS (SELECT mt.paper_id, mt.figure_id, text AS series, avg(h) AS h, avg(s) AS s, avg(v) AS v, count(*) AS n FROM mt JOIN (SELECT det_id AS marker_id, {HSV} FROM det) c USING (marker_id) JOIN txt ON txt.det_id = text_id GROUP BY ALL)"
_DIST = "4.0 * (least(abs(p.h - q.h), 180 - abs(p.h - q.h)) / 180.0) + 1.5 * abs(p.s - q.s) / 255.0 + 0.5 * abs(p.v - q.v) / 255.0"
_NS = f"ns AS (SELECT p.det_id, arg_min(q.series, {{'d': {_DIST}, 's': q.series}}) AS series FROM (SELECT *, {HSV} FROM det WHERE label = 'data_point') p JOIN pr q ON p.paper_id = q.paper_id AND p.figure_id = q.figure_id GROUP BY p.det_id)"
_NV = "{name} AS (SELECT p.det_id, arg_min(q.det_id, {{'d': sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)), 'i': q.det_id}}) AS value_id FROM {points} p JOIN det q ON p.paper_id = q.paper_id AND p.figure_id = q.figure_id AND q.label = 'value_label' WHERE sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) < 120 GROUP BY p.det_id)"


def _protos(x: DataFrame) -> DataFrame:
    named = series.marker_texts(x).join(texts(x).select(F.col("det_id").alias("text_id"), F.col("text").alias("series")), "text_id")
    return series.prototypes(named.join(coloured(x).select(F.col("det_id").alias("marker_id"), "h", "s", "v"), "marker_id"))


@query(f"WITH {DET}, {_MT} SELECT marker_id, text_id FROM mt")
def legend_text_nn(spark, d):
    return series.marker_texts(dets(spark, d)).select("marker_id", "text_id")


@query(f"WITH {DET}, {TXT}, {_MT}, {_PR} SELECT paper_id, figure_id, series, round(h, 4) AS h, round(s, 4) AS s, round(v, 4) AS v, n FROM pr")
def prototypes(spark, d):
    return _protos(dets(spark, d)).select(*FIGURE, "series", *(F.round(c, 4).alias(c) for c in "hsv"), "n")


@query(f"WITH {DET}, {TXT}, {_MT}, {_PR}, {_NS} SELECT det_id, series FROM ns")
def series_nn(spark, d):
    x = dets(spark, d)
    return series.nearest_series(coloured(x.where("label = 'data_point'")), _protos(x)).select("det_id", "series")


@query(f"WITH {DET}, {_NV.format(name='nv', points='(SELECT * FROM det WHERE label = ' + chr(39) + 'data_point' + chr(39) + ')')} SELECT det_id, value_id FROM nv")
def value_nn(spark, d):
    x = dets(spark, d)
    return series.nearest_value(x.where("label = 'data_point'"), x.where("label = 'value_label'")).select("det_id", "value_id")


_PRED = "CASE WHEN {m}.is_log THEN pow(10, {m}.slope * {p} + {m}.intercept) ELSE {m}.slope * {p} + {m}.intercept END"
#: Raw detections become det through suppression, the density rule and the nested filter; figures of mostly dark or coloured pixels are heatmaps.
_CHAIN = f"""{DET.replace("det AS", "raw AS", 1)}, {_NMS.replace("FROM det)", "FROM raw)")},
    md AS (SELECT raw.*, count(*) OVER (PARTITION BY paper_id, figure_id) AS n_ FROM raw JOIN nm USING (det_id)), dn AS (SELECT * EXCLUDE (n_) FROM md WHERE n_ <= 150 OR conf >= 0.4),
    {_NEST.format(src="dn", iou=_IOU)}, det AS (SELECT * FROM dn WHERE det_id NOT IN (SELECT det_id FROM gone)),
    modes AS (SELECT paper_id, figure_id, avg(CASE WHEN least(255.0, det_id * 53 % 256 * 2.5) > 240 THEN 1.0 ELSE 0.0 END) < 0.6 AS heatmap FROM raw GROUP BY ALL)"""
_HEAT = "LEFT JOIN modes USING (paper_id, figure_id)"
_VOTE_H = _VOTE.replace("vote AS (", "vote0 AS (") + f", vote AS (SELECT paper_id, figure_id, axis, CASE WHEN axis <> 'x' AND coalesce(heatmap, false) THEN false ELSE is_log END AS is_log FROM vote0 {_HEAT})"
_MAP = f"""WITH RECURSIVE {_CHAIN}, {TXT}, {_B2}, {_CAND}, {_ALIGN}, {_VOTE_H}, {_FIT}, {_LINES}, {_MT}, {_PR}, {_NS},
    gp AS (SELECT det.* FROM det LEFT JOIN lines USING (paper_id, figure_id) WHERE label = 'data_point' AND {_GHOST}),
    d3 AS (SELECT paper_id, figure_id, c >= 2 AND r - l > 400 AS dual3 FROM (SELECT paper_id, figure_id, arg_min(mid, bin) AS l, arg_max(mid, bin) AS r, count(*) AS c FROM xb WHERE n >= 3 GROUP BY ALL)),
    vb AS (SELECT det.* REPLACE (CASE WHEN coalesce(heatmap, false) AND NOT coalesce(dual3, false) AND x_min > 0 AND y_max < 800 AND label IN ('tick_label', 'text', 'value') AND cx > x_min + 15 AND cy < y_max - 15 THEN 'value_label' ELSE label END AS label)
      FROM det JOIN bounds USING (paper_id, figure_id) LEFT JOIN d3 USING (paper_id, figure_id) {_HEAT}), {_NV.format(name="nv", points="gp").replace("JOIN det q", "JOIN vb q")},
    mapped AS (SELECT gp.paper_id, gp.figure_id, gp.det_id, coalesce(ns.series, 'Default') AS series, {_PRED.format(m="mx", p="cx")} AS x, {_PRED.format(m="ml", p="cy")} AS y_left,
      CASE WHEN coalesce(dual3, false) AND mr.slope IS NOT NULL THEN {_PRED.format(m="mr", p="cy")} ELSE {_parse("vt.text")} END AS y_right_or_value
    FROM gp JOIN model mx ON gp.paper_id = mx.paper_id AND gp.figure_id = mx.figure_id AND mx.axis = 'x' AND mx.slope IS NOT NULL
    LEFT JOIN model ml ON gp.paper_id = ml.paper_id AND gp.figure_id = ml.figure_id AND ml.axis = 'yl' AND ml.slope IS NOT NULL LEFT JOIN model mr ON gp.paper_id = mr.paper_id AND gp.figure_id = mr.figure_id AND mr.axis = 'yr' AND mr.slope IS NOT NULL
    LEFT JOIN d3 ON gp.paper_id = d3.paper_id AND gp.figure_id = d3.figure_id LEFT JOIN nv ON nv.det_id = gp.det_id LEFT JOIN txt vt ON vt.det_id = nv.value_id LEFT JOIN ns ON ns.det_id = gp.det_id)"""


def _modes(x: DataFrame) -> DataFrame:
    """Which figures are heatmaps, by the share of their recorded pixels that are white."""
    return pixels.heatmaps(recorded_pixels(x), FIGURE).select(*FIGURE, "heatmap", F.lit(False).alias("log_x"))


def _mapped(spark, d):
    raw = dets(spark, d)
    x = points.cleaned(raw)
    return x, points.mapped(x, texts(x), series.nearest_series(coloured(x.where("label = 'data_point'")), _protos(x)), _modes(raw))


@query(f"{_MAP} SELECT det_id, series, round(x, 2) AS x, round(y_left, 2) AS y_left, round(y_right_or_value, 2) AS y_right_or_value FROM mapped")
def map_points(spark, d):
    return _mapped(spark, d)[1].select("det_id", "series", *(F.round(c, 2).alias(c) for c in ("x", "y_left", "y_right_or_value")))


@query(f"{_MAP} SELECT det_id, 'Default' AS series, cx AS x_pixel, cy AS y_pixel, 'CoordMapping Failed' AS note FROM det WHERE label = 'data_point' AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.paper_id = det.paper_id AND m.figure_id = det.figure_id)")
def pixel_fallback(spark, d):
    x, m = _mapped(spark, d)
    return points.pixel_fallback(x, m).drop(*FIGURE)


@query(f"WITH {DET} SELECT paper_id, figure_id, count(*) AS n, count(*) FILTER (label = 'data_point') AS points, count(*) FILTER (label = 'tick_label') AS tick_labels, round(avg(conf), 6) AS mean_conf FROM det GROUP BY ALL")
def figure_stats(spark, d):
    return dets(spark, d).groupBy(*FIGURE).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "data_point").alias("points"), F.count_if(F.col("label") == "tick_label").alias("tick_labels"), F.round(F.avg("conf"), 6).alias("mean_conf"))
