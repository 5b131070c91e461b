"""Queries over table cells and annotations, each with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.operators import detect, pixels, tables
from figmill.operators.tables import SPAN, TABLE
from figmill.plans.figures import DET, dets, recorded_pixels
from figmill.session import table
from figmill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


CELLS = "cells AS (SELECT paper_id, table_id, cell_id, cell_idx, row_index, col_index, row_span, col_span, score, label, content, box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2, (box.x1 + box.x2) / 2 AS cx, (box.y1 + box.y2) / 2 AS cy FROM table_cells)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.flat_cells(table(spark, d, "table_cells")).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


@query(f"WITH {CELLS} SELECT paper_id, table_id, arg_max(cell_id, {{'s': score, 'i': -cell_id}}) AS cell_id, max(score) AS score FROM cells GROUP BY ALL")
def best_body(spark, d):
    return tables.best_bodies(cells(spark, d))


@query(f"WITH {CELLS} SELECT cell_id, CAST(0 AS DOUBLE) AS x1, y1, CAST(1000 AS DOUBLE) AS x2, least(CAST(800 AS DOUBLE), y2 + 10) AS y2 FROM cells")
def body_cut(spark, d):
    return cells(spark, d).select("cell_id", *tables.body_box(1000, 800))


@query(f"WITH {CELLS}, m AS (SELECT paper_id, table_id, coalesce(max(score), 0.0) AS top FROM cells GROUP BY ALL) SELECT paper_id, table_id, top >= 0.9 AS is_table, top AS conf, CASE WHEN top >= 0.9 THEN '' ELSE 'Filtered by YOLO' END AS reason FROM m UNION ALL SELECT paper_id || ' (no model)', table_id, true, 0.0, 'Model not loaded' FROM m")
def table_accept(spark, d):
    c = cells(spark, d)
    return tables.accepted(c).unionByName(tables.accepted(c, model=False).withColumn("paper_id", F.concat("paper_id", F.lit(" (no model)"))))


@query(f"WITH {CELLS} SELECT cell_id, score FROM cells WHERE score >= 0.7 ORDER BY score DESC, cell_id")
def comp_log(spark, d):
    return cells(spark, d).where("score >= 0.7").orderBy(F.desc("score"), "cell_id").select("cell_id", "score")


@query(f"WITH {CELLS} SELECT paper_id, table_id, label, count(*) AS n, round(max(score), 3) AS best FROM cells WHERE label IS NOT NULL GROUP BY ALL")
def comp_map(spark, d):
    per = cells(spark, d).where("label is not null").groupBy(*TABLE, "label").agg(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 3).alias("best")).alias("c"))
    maps = per.groupBy(*TABLE).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("m"))
    return maps.select(*TABLE, F.explode("m").alias("label", "c")).select(*TABLE, "label", "c.n", "c.best")


_SIDE = """{n} AS (SELECT paper_id, table_id, row_number() OVER (PARTITION BY paper_id, table_id ORDER BY {by}, {i}) - 1 AS ord, * EXCLUDE (paper_id, table_id) FROM
    (SELECT paper_id, table_id, {i}, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(score) + 1e-9, 3) AS score FROM cells WHERE label <> 'table spanning cell' AND {i} IS NOT NULL GROUP BY ALL))"""
_SIDES = _SIDE.format(n="rw", by="y1", i="row_index") + ", " + _SIDE.format(n="cl", by="x1", i="col_index")


@query(
    f"""WITH {CELLS}, {_SIDES} SELECT rw.paper_id, rw.table_id, CAST(rw.ord AS INTEGER) AS row_index, CAST(cl.ord AS INTEGER) AS col_index, greatest(rw.x1, cl.x1) AS x1, greatest(rw.y1, cl.y1) AS y1, least(rw.x2, cl.x2) AS x2, least(rw.y2, cl.y2) AS y2, round((rw.score + cl.score) / 2 + 1e-9, 2) AS score
    FROM rw JOIN cl ON rw.paper_id = cl.paper_id AND rw.table_id = cl.table_id WHERE least(rw.x2, cl.x2) > greatest(rw.x1, cl.x1) AND least(rw.y2, cl.y2) > greatest(rw.y1, cl.y1)"""
)
def table_grid(spark, d):
    return tables.grid(*tables.rows_and_columns(cells(spark, d)))


_SPANS = "spans AS (SELECT paper_id, table_id, cell_id AS span_id, x1 - 5 AS x1, y1 - 2 AS y1, x1 + 250 AS x2, y2 + 2 AS y2 FROM cells WHERE label = 'table spanning cell' OR cell_id % 29 = 0), base AS (SELECT * FROM cells WHERE label = 'cell' AND cell_id % 29 <> 0)"


@query(
    f"""WITH {CELLS}, {_SPANS}, cov AS (SELECT b.paper_id, b.table_id, b.cell_id, b.row_index, b.col_index, min(span_id) AS span_id FROM base b JOIN spans s ON b.paper_id = s.paper_id AND b.table_id = s.table_id
    AND least(b.x2, s.x2) > greatest(b.x1, s.x1) AND least(b.y2, s.y2) > greatest(b.y1, s.y1) AND (least(b.x2, s.x2) - greatest(b.x1, s.x1)) * (least(b.y2, s.y2) - greatest(b.y1, s.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1)) > 0.6 GROUP BY ALL)
    SELECT span_id AS cell_id, 'table spanning cell' AS label, min(row_index) AS row_index, min(col_index) AS col_index, max(row_index) - min(row_index) + 1 AS row_span, max(col_index) - min(col_index) + 1 AS col_span FROM cov GROUP BY paper_id, table_id, span_id
    UNION ALL SELECT cell_id, 'cell', row_index, col_index, 1, 1 FROM base WHERE cell_id NOT IN (SELECT cell_id FROM cov)"""
)
def span_merge(spark, d):
    c = cells(spark, d)
    wide = {"x1": F.col("x1") - 5, "y1": F.col("y1") - 2, "x2": F.col("x1") + 250, "y2": F.col("y2") + 2}
    spans = c.where(f"label = '{SPAN}' or cell_id % 29 = 0").select(*TABLE, "cell_id", *(e.alias(k) for k, e in wide.items()))
    return tables.merged(c.where("label = 'cell' and cell_id % 29 <> 0"), spans).drop(*TABLE)


_GAP = "{n} AS (SELECT paper_id, table_id, CAST(ord AS INTEGER) AS ord, avg(pos) AS centre, count(*) AS n FROM (SELECT paper_id, table_id, pos, sum(opens) OVER (PARTITION BY paper_id, table_id ORDER BY pos, cell_id ROWS UNBOUNDED PRECEDING) AS ord FROM (SELECT paper_id, table_id, cell_id, {c} AS pos, CASE WHEN {c} - lag({c}) OVER (PARTITION BY paper_id, table_id ORDER BY {c}, cell_id) > 10 THEN 1 ELSE 0 END AS opens FROM cells WHERE {c} IS NOT NULL)) GROUP BY ALL)"


@query(f"WITH {CELLS}, {_GAP.format(n='g', c='cy')} SELECT paper_id, table_id, ord, n FROM g")
def gap_rows(spark, d):
    return tables.gap_clusters(cells(spark, d), "cy").select(*TABLE, "ord", "n")


@query(f"WITH {CELLS}, {_GAP.format(n='g', c='cx')} SELECT paper_id, table_id, ord, round(centre, 4) AS centre FROM g")
def grid_centers(spark, d):
    return tables.gap_clusters(cells(spark, d), "cx").select(*TABLE, "ord", F.round("centre", 4).alias("centre"))


@query(
    f"""WITH {CELLS}, {_GAP.format(n='gr', c='cy')}, {_GAP.format(n='gc', c='cx')}
    SELECT c.cell_id, r.i AS row_index, k.i AS col_index FROM cells c
    JOIN (SELECT cell_id, arg_min(ord, {{'d': round(abs(centre - cy), 9), 'o': ord}}) AS i FROM cells JOIN gr USING (paper_id, table_id) GROUP BY cell_id) r USING (cell_id)
    JOIN (SELECT cell_id, arg_min(ord, {{'d': round(abs(centre - cx), 9), 'o': ord}}) AS i FROM cells JOIN gc USING (paper_id, table_id) GROUP BY cell_id) k USING (cell_id)"""
)
def grid_assign(spark, d):
    return tables.assigned(cells(spark, d))


@query(
    f"""WITH {CELLS}, {_GAP.format(n='gr', c='cy')}, {_GAP.format(n='gc', c='cx')}
    SELECT c.cell_id, coalesce(CASE WHEN row_index > 1 THEN row_index END, r.i) AS row_index, coalesce(CASE WHEN row_index > 1 THEN col_index END, k.i) AS col_index FROM cells c
    LEFT JOIN (SELECT cell_id, arg_min(ord, {{'d': round(abs(centre - cy), 9), 'o': ord}}) AS i FROM cells JOIN gr USING (paper_id, table_id) GROUP BY cell_id) r USING (cell_id)
    LEFT JOIN (SELECT cell_id, arg_min(ord, {{'d': round(abs(centre - cx), 9), 'o': ord}}) AS i FROM cells JOIN gc USING (paper_id, table_id) GROUP BY cell_id) k USING (cell_id)"""
)
def grid_placed(spark, d):
    """Positions of cells, of which the first rows are taken as not numbered."""
    c = cells(spark, d)
    some = c.withColumns({k: F.when(F.col("row_index") > 1, F.col(k)) for k in ("col_index", "row_index")})
    return tables.placed(some).select("cell_id", "row_index", "col_index")


@query(
    f"""WITH {CELLS} SELECT paper_id, table_id, reason = '' AS is_valid, reason FROM (SELECT paper_id, table_id, CASE WHEN coalesce(max(score), 0) < 0.9 THEN 'Filtered by YOLO' WHEN count(*) FILTER (label = 'cell') = 0 THEN 'No cells detected'
      WHEN count(*) FILTER (label = 'cell' AND content <> '') = 0 THEN 'No content extracted' ELSE '' END AS reason FROM cells GROUP BY ALL)"""
)
def table_outcome(spark, d):
    c = cells(spark, d)
    return tables.outcome(tables.accepted(c).select(*TABLE, F.col("is_table").alias("accepted"), F.lit(True).alias("readable")), c.where("label = 'cell'"))


_P = ", ".join(f"coalesce(arg_max(coalesce(content, ''), cell_id) FILTER (col_index = {i}), '') AS c{i}" for i in range(6))


@query(f"WITH {CELLS}, fr AS (SELECT paper_id, table_id, CAST(unnest(range(0, max(row_index) + 1)) AS INTEGER) AS row_index FROM cells WHERE row_index IS NOT NULL AND col_index IS NOT NULL GROUP BY paper_id, table_id) SELECT fr.paper_id, fr.table_id, fr.row_index, {_P} FROM fr LEFT JOIN cells c ON fr.paper_id = c.paper_id AND fr.table_id = c.table_id AND fr.row_index = c.row_index GROUP BY ALL")
def grid_pivot(spark, d):
    return tables.pivoted(cells(spark, d))


@query(f"WITH {CELLS} SELECT cell_id, CASE WHEN cell_id % 5 = 0 THEN 'Structure' WHEN cell_id % 7 = 0 THEN 'Error' ELSE 'Text' END AS kind, CASE WHEN cell_id % 5 = 0 THEN '[MolScribe Missing]' ELSE content END AS content FROM cells")
def content_dispatch(spark, d):
    kind = F.when(F.col("cell_id") % 5 == 0, "Structure").when(F.col("cell_id") % 7 == 0, "Error").otherwise("Text")
    return tables.dispatched(cells(spark, d).withColumn("kind", kind)).select("cell_id", "kind", "content")


# --- annotations ---------------------------------------------------------------


@query(f"WITH {DET} SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS id, label AS name FROM (SELECT DISTINCT label FROM det)")
def coco_categories(spark, d):
    return tables.sequential(dets(spark, d).select(F.col("label").alias("name")).distinct(), "name", "id")


@query(f"WITH {DET} SELECT CAST(row_number() OVER (ORDER BY file_name) - 1 AS BIGINT) AS id, file_name, 1000 AS width, 800 AS height FROM (SELECT DISTINCT paper_id || '/' || figure_id || '.png' AS file_name FROM det)")
def coco_images(spark, d):
    files = dets(spark, d).select(F.concat("paper_id", F.lit("/"), "figure_id", F.lit(".png")).alias("file_name")).distinct()
    return tables.sequential(files, "file_name", "id").select("id", "file_name", F.lit(1000).alias("width"), F.lit(800).alias("height"))


_CO = "SELECT det_id, greatest(0.0, x1) AS x, greatest(0.0, y1) AS y, least(1000.0, x2) - greatest(0.0, x1) AS w, least(800.0, y2) - greatest(0.0, y1) AS h, conf FROM det WHERE conf >= 0.5"


@query(f"WITH {DET} SELECT CAST(row_number() OVER (ORDER BY det_id) AS BIGINT) AS id, det_id, x, y, w, h, round(w * h, 4) AS area, 0 AS iscrowd, conf AS score FROM ({_CO}) WHERE w > 0 AND h > 0")
def coco_annotations(spark, d):
    a = tables.annotations(detect.confident(dets(spark, d), 0.5), 1000, 800)
    return tables.sequential(a, "det_id", "id", 1).select("id", "det_id", "x", "y", "w", "h", F.round(F.col("w") * F.col("h"), 4).alias("area"), F.lit(0).alias("iscrowd"), "score")


# --- scalar remainders -----------------------------------------------------------


@query(f"WITH {DET} SELECT det_id, CASE WHEN x2 - x1 < 50 OR y2 - y1 < 50 THEN 3 ELSE 1 END AS axis_scale, CASE WHEN x2 - x1 < 60 OR y2 - y1 < 60 THEN 4 ELSE 1 END AS value_scale, CASE WHEN y2 - y1 < 100 OR x2 - x1 < 200 THEN 3 ELSE 1 END AS legend_scale FROM det")
def ocr_scale(spark, d):
    return dets(spark, d).select("det_id", *tables.reading_scale(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


@query(f"WITH {DET} SELECT paper_id, figure_id, round(avg(CASE WHEN least(255.0, det_id * 53 % 256 * 2.5) > 240 THEN 1.0 ELSE 0.0 END), 6) AS white, avg(CASE WHEN least(255.0, det_id * 53 % 256 * 2.5) > 240 THEN 1.0 ELSE 0.0 END) < 0.6 AS heatmap FROM det GROUP BY ALL")
def white_ratio(spark, d):
    return pixels.heatmaps(recorded_pixels(dets(spark, d)), ["paper_id", "figure_id"]).withColumn("white", F.round("white", 6))


#: Pixels from -500 to 500 and from -400 to 400, with the widths 1000 / 2.5 and 800 / 2.5.
_WT = "exp(-(pow(floor(cx) * 1000 / 999 - 500, 2) / (2 * 400.0 * 400.0) + pow(floor(cy) * 800 / 799 - 400, 2) / (2 * 320.0 * 320.0)))"
_RGB = ", ".join(f"floor(sum((det_id * {k} % 256) * {_WT}) / sum({_WT}) + 1e-9) AS {c}" for k, c in ((37, "r"), (53, "g"), (71, "b")))


@query(
    f"""WITH {DET}, m AS (SELECT paper_id, figure_id, {_RGB} FROM det GROUP BY ALL), t AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM m),
    a AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN top = r THEN 60.0 * (g - b) / span WHEN top = g THEN 120.0 + 60.0 * (b - r) / span ELSE 240.0 + 60.0 * (r - g) / span END AS turn FROM t)
    SELECT paper_id, figure_id, round((turn + CASE WHEN turn < 0 THEN 360.0 ELSE 0.0 END) / 2.0) % 180 AS h, CASE WHEN top = 0 THEN 0.0 ELSE round(255.0 * span / top) END AS s, top AS v FROM a"""
)
def weighted_mean(spark, d):
    return pixels.weighted_colour(recorded_pixels(dets(spark, d)), ["paper_id", "figure_id"])


@query(f"WITH {DET} SELECT det_id, least(x1, x2, (x1 + x2) / 2) AS qx1, least(y1, y2) AS qy1, greatest(x1, x2) AS qx2, greatest(y1, y2) AS qy2 FROM det")
def quad_bbox(spark, d):
    quad = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    return dets(spark, d).select("det_id", *tables.quad_box(quad))


_TE = f"""t AS (SELECT * FROM det WHERE label = 'data_point'), e AS (SELECT * FROM det WHERE label IN ('text', 'tick_label'))"""


@query(
    f"""WITH {DET}, {_TE}, p AS (SELECT t.det_id AS target_id, e.det_id AS element_id, CASE WHEN e.label = 'text' AND e.y1 >= t.y2 - 20 THEN 'caption' ELSE e.label END AS label,
      greatest(t.x1, e.x1) - t.x1 AS mx1, greatest(t.y1, e.y1) - t.y1 AS my1, least(t.x2, e.x2) - t.x1 AS mx2, least(t.y2, e.y2) - t.y1 AS my2, least(t.x2, e.x2) > greatest(t.x1, e.x1) AND least(t.y2, e.y2) > greatest(t.y1, e.y1) AS meets, e.label = 'text' AND least(t.x2, e.x2) - greatest(t.x1, e.x1) > 0.5 * least(t.x2 - t.x1, e.x2 - e.x1) AS above
      FROM t JOIN e ON t.paper_id = e.paper_id AND t.figure_id = e.figure_id)
    SELECT target_id, element_id, label, meets AND label <> 'caption' AS masked, CASE WHEN meets AND label <> 'caption' THEN mx1 END AS mx1, CASE WHEN meets AND label <> 'caption' THEN my1 END AS my1, CASE WHEN meets AND label <> 'caption' THEN mx2 END AS mx2, CASE WHEN meets AND label <> 'caption' THEN my2 END AS my2,
      CAST(row_number() OVER (PARTITION BY target_id, label ORDER BY element_id) - 1 AS INTEGER) AS elem_idx FROM p WHERE meets OR above"""
)
def target_elements(spark, d):
    x = dets(spark, d)
    e = tables.target_elements(x.where("label = 'data_point'"), x.where("label in ('text', 'tick_label')"), ["paper_id", "figure_id"])
    return e.select("target_id", "element_id", "label", "masked", *(F.col(f"mask.{c}").alias(f"m{c}") for c in ("x1", "y1", "x2", "y2")), "elem_idx")


@query(
    f"""WITH {DET}, im AS (SELECT count(DISTINCT paper_id || '/' || figure_id) AS n FROM det), an AS (SELECT count(*) AS n FROM (SELECT least(1000.0, x2) - greatest(0.0, x1) AS w, least(800.0, y2) - greatest(0.0, y1) AS h FROM det WHERE conf >= 0.5) WHERE w > 0 AND h > 0), ca AS (SELECT count(DISTINCT label) AS n FROM det)
    SELECT 'images' AS part, n AS lines, CAST(n AS BIGINT) AS total FROM im UNION ALL SELECT 'annotations', n, n FROM an UNION ALL SELECT 'categories', n, n FROM ca"""
)
def coco_document(spark, d):
    """The annotation document's lines by part, beside the totals it states itself."""
    doc = files.coco_document(coco_images(spark, d), coco_annotations(spark, d), coco_categories(spark, d))
    said = doc.where("part = 'info'").select(F.get_json_object("value", "$.of").alias("part"), F.get_json_object("value", "$.total").cast("long").alias("total"))
    return doc.where("part <> 'info'").groupBy("part").agg(F.count(F.lit(1)).alias("lines")).join(said, "part")
