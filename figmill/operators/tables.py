"""Operators on tables: grids from rows and columns, spanning cells, positions by gaps, pivots and annotations.

The key of a table is (paper_id, table_id).

Edge cases: null indices, boxes or contents are left out of the step that needs them;
repeated cells take the last cell_id (a grid) or stay (annotations); equal
distances take the lower index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from figmill.functions import geometry as g
from figmill.operators.detect import BOX
from figmill.session import cut

TABLE = ["paper_id", "table_id"]
SPAN = "table spanning cell"


def flat_cells(cells: DataFrame) -> DataFrame:
    return cells.select(*TABLE, "cell_id", "cell_idx", "row_index", "col_index", "row_span", "col_span", "score", "label", "content", *(F.col(f"box.{c}").alias(c) for c in BOX))


def rows_and_columns(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row and column boxes with a score and an ordinal by their place."""

    def side(index: str, by: str) -> DataFrame:
        s = cells.where(F.col("label") != SPAN).groupBy(*TABLE, index).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("score") + 1e-9, 3).alias("score")).where(F.col(index).isNotNull())
        return s.withColumn("ord", F.row_number().over(W.partitionBy(*TABLE).orderBy(by, index)) - 1).select(*TABLE, "ord", *BOX, "score")

    return side("row_index", "y1"), side("col_index", "x1")


def grid(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """row_index, col_index, box, score: the cells where rows and columns meet in a positive area."""
    r = rows.select(*TABLE, F.col("ord").alias("row_index"), *(F.col(c).alias(f"r_{c}") for c in [*BOX, "score"]))
    c = cols.select(*TABLE, F.col("ord").alias("col_index"), *(F.col(k).alias(f"c_{k}") for k in [*BOX, "score"]))
    box = [F.greatest("r_x1", "c_x1").alias("x1"), F.greatest("r_y1", "c_y1").alias("y1"), F.least("r_x2", "c_x2").alias("x2"), F.least("r_y2", "c_y2").alias("y2")]
    score = F.round((F.col("r_score") + F.col("c_score")) / 2 + 1e-9, 2).alias("score")
    return r.join(c, TABLE).where(g.intersection("r_", "c_") > 0).select(*TABLE, "row_index", "col_index", *box, score)


def merged(cells: DataFrame, spans: DataFrame, at_least: float = 0.6) -> DataFrame:
    """Grid cells with spanning cells in place of what they cover; the first span that covers a cell claims it."""
    a = cells.select(*TABLE, "cell_id", "row_index", "col_index", *BOX)
    b = spans.select(*TABLE, F.col("cell_id").alias("span_id"), *BOX)
    covers = g.overlapping(a, b, TABLE).where(F.try_divide(g.intersection("a_", "b_"), g.area("a_")) > at_least)
    claims = covers.groupBy(F.col("a_paper_id").alias("paper_id"), F.col("a_table_id").alias("table_id"), F.col("a_cell_id").alias("cell_id"), F.col("a_row_index").alias("row_index"), F.col("a_col_index").alias("col_index")).agg(F.min("b_span_id").alias("span_id"))
    lo_r, lo_c = F.min("row_index"), F.min("col_index")
    spanning = claims.groupBy(*TABLE, "span_id").agg(lo_r.alias("row_index"), lo_c.alias("col_index"), (F.max("row_index") - lo_r + 1).alias("row_span"), (F.max("col_index") - lo_c + 1).alias("col_span")).select(*TABLE, F.col("span_id").alias("cell_id"), F.lit(SPAN).alias("label"), "row_index", "col_index", "row_span", "col_span")
    rest = cells.join(claims.select("cell_id"), "cell_id", "left_anti").select(*TABLE, "cell_id", F.lit("cell").alias("label"), "row_index", "col_index", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    return spanning.unionByName(rest)


def _gaps(cells: DataFrame, coordinate: str, gap: float) -> DataFrame:
    """at, k, ord: the distinct values of a coordinate, how many cells have them, and their cluster."""
    at = cells.where(F.col(coordinate).isNotNull()).groupBy(*TABLE, F.col(coordinate).alias("at")).agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*TABLE).orderBy("at")
    opens = F.when(F.col("at") - F.lag("at").over(w) > gap, 1).otherwise(0)
    return at.withColumn("opens", opens).withColumn("ord", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("opens")


def gap_clusters(cells: DataFrame, coordinate: str, gap: float = 10.0) -> DataFrame:
    """ord, centre, n: clusters of a coordinate, a new one after each gap. Equal coordinates are counted before the window."""
    return _gaps(cells, coordinate, gap).groupBy(*TABLE, "ord").agg(F.try_divide(F.sum(F.col("at") * F.col("k")), F.sum("k")).alias("centre"), F.sum("k").alias("n"))


def nearest_centre(cells: DataFrame, coordinate: str, gap: float = 10.0) -> DataFrame:
    """at, index: the nearest cluster centre of each distinct value of a coordinate, of equally near ones the lower.

    Clusters and their centres stand in the same order, so of all centres only those of a value's own cluster and of its
    two neighbours can be nearest: no value meets every centre."""
    part = _gaps(cells, coordinate, gap)
    # over the values of a table that are already sorted: the centre of the own cluster, then of those before and after
    centres = part.groupBy(*TABLE, "ord").agg(F.try_divide(F.sum(F.col("at") * F.col("k")), F.sum("k")).alias("centre"))
    w = W.partitionBy(*TABLE).orderBy("ord")
    beside = centres.select(*TABLE, "ord", F.lag("centre").over(w).alias("before"), "centre", F.lead("centre").over(w).alias("after"))
    far = lambda c, i: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c) - F.col("at")).alias("d"), (F.col("ord") + i).alias("ord")))
    return part.join(beside, [*TABLE, "ord"]).select(*TABLE, "at", F.least(far("before", -1), far("centre", 0), far("after", 1))["ord"].cast("int").alias("index"))


def assigned(cells: DataFrame, gap: float = 10.0) -> DataFrame:
    """cell_id, row_index, col_index: the nearest row and column centre of each cell."""
    rows = nearest_centre(cells, "cy", gap).select(*TABLE, F.col("at").alias("cy"), F.col("index").alias("row_index"))
    cols = nearest_centre(cells, "cx", gap).select(*TABLE, F.col("at").alias("cx"), F.col("index").alias("col_index"))
    return cells.select(*TABLE, "cell_id", "cx", "cy").join(rows, [*TABLE, "cy"]).join(cols, [*TABLE, "cx"]).select("cell_id", "row_index", "col_index")


def pivoted(cells: DataFrame, width: int = 6) -> DataFrame:
    """row_index, c0 .. c<width - 1>: the texts of a table by row, "" where there is none, the last cell_id winning.

    There are at least ``width`` columns, and as many as the widest table has: its last column is asked for first."""
    last = cells.where("row_index is not null and col_index is not null").agg(F.max("col_index")).first()[0]
    width = max(width, 0 if last is None else last + 1)
    top = cells.where("row_index is not null and col_index is not null").groupBy(*TABLE).agg(F.max("row_index").alias("last_row"))
    frame = top.select(*TABLE, F.explode(F.sequence(F.lit(0), F.col("last_row"))).alias("row_index"))
    cols = [F.max_by(F.when(F.col("col_index") == c, F.coalesce("content", F.lit(""))), F.when(F.col("col_index") == c, F.col("cell_id"))).alias(f"c{c}") for c in range(width)]
    wide = cells.where("row_index is not null and col_index is not null").groupBy(*TABLE, "row_index").agg(*cols)
    return frame.join(wide, [*TABLE, "row_index"], "left").select(*TABLE, "row_index", *(F.coalesce(f"c{c}", F.lit("")).alias(f"c{c}") for c in range(width)))


def placed(cells: DataFrame) -> DataFrame:
    """Cells with a position: their own, else that of the nearest row and column centre of their table."""
    at = cells.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    near = assigned(at).select("cell_id", F.col("row_index").alias("row_"), F.col("col_index").alias("col_"))
    return cells.join(near, "cell_id", "left").withColumns({"row_index": F.coalesce("row_index", "row_"), "col_index": F.coalesce("col_index", "col_")}).drop("row_", "col_")


def best_bodies(cells: DataFrame) -> DataFrame:
    """cell_id, score: the most certain body of each table, of equals the lower cell_id."""
    return cells.groupBy(*TABLE).agg(F.max_by("cell_id", F.struct("score", -F.col("cell_id"))).alias("cell_id"), F.max("score").alias("score"))


def body_box(width: float, height: float, below: float = 10.0) -> list[Column]:
    """x1, y1, x2, y2 of what is cut out for a body: the whole width, from its top to a little below it."""
    return [F.lit(0.0).alias("x1"), F.col("y1"), F.lit(float(width)).alias("x2"), F.least(F.lit(float(height)), F.col("y2") + below).alias("y2")]


def accepted(cells: DataFrame, least: float = 0.9, model: bool = True) -> DataFrame:
    """is_table, conf, reason: whether an image is a table. Without a model every image counts as one, with no confidence."""
    if not model:
        return cells.groupBy(*TABLE).agg(F.lit(True).alias("is_table"), F.lit(0.0).alias("conf"), F.lit("Model not loaded").alias("reason"))
    top = F.coalesce(F.max("score"), F.lit(0.0))
    return cells.groupBy(*TABLE).agg((top >= least).alias("is_table"), top.alias("conf"), F.when(top >= least, "").otherwise("Filtered by YOLO").alias("reason"))


def dispatched(cells: DataFrame, kind: str = "kind", readers: frozenset[str] = frozenset({"Text"})) -> DataFrame:
    """content by the class of a cell (Structure, Text, Error): structures without their reader say so."""
    missing = (F.col(kind) == "Structure") & F.lit("Structure" not in readers)
    return cells.withColumn("content", F.when(missing, "[MolScribe Missing]").otherwise(F.col("content")))


def reading_scale(w: Column, h: Column) -> list[Column]:
    """axis_scale, value_scale, legend_scale: how much small crops are enlarged before they are read."""
    return [F.when((w < 50) | (h < 50), 3).otherwise(1).alias("axis_scale"), F.when((w < 60) | (h < 60), 4).otherwise(1).alias("value_scale"), F.when((h < 100) | (w < 200), 3).otherwise(1).alias("legend_scale")]


def quad_box(quad: Column) -> list[Column]:
    """qx1, qy1, qx2, qy2: the upright box around a quadrilateral (an array of points)."""
    side = lambda f, i: f(F.transform(quad, lambda p: p[i]))
    return [side(F.array_min, 0).alias("qx1"), side(F.array_min, 1).alias("qy1"), side(F.array_max, 0).alias("qx2"), side(F.array_max, 1).alias("qy2")]


def stacked(rows: DataFrame, keys: list[str], order: str, height: str, space: int = 10) -> DataFrame:
    """y_offset: where each crop starts when crops are stacked with a space between."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("y_offset", F.coalesce(F.sum(F.col(height) + space).over(w), F.lit(0)).cast("long"))


def annotations(dets: DataFrame, width: float, height: float) -> DataFrame:
    """det_id, x, y, w, h, score: boxes cut to the image, in the form of annotations; what lies outside is left out."""
    x, y = F.greatest(F.lit(0.0), F.col("x1")), F.greatest(F.lit(0.0), F.col("y1"))
    return dets.select("det_id", x.alias("x"), y.alias("y"), (F.least(F.lit(float(width)), F.col("x2")) - x).alias("w"), (F.least(F.lit(float(height)), F.col("y2")) - y).alias("h"), F.col("conf").alias("score")).where("w > 0 and h > 0")


def target_elements(targets: DataFrame, elements: DataFrame, keys: list[str], size: float = 100.0) -> DataFrame:
    """target_id, element_id, label, masked, mask, elem_idx: the elements of each target (det_id and box on either side).

    An element belongs to a target if they meet, or if it is a text above or below it that shares over half of the lesser
    width. Texts from the target's lower edge on are captions. ``mask`` is the part of the target, in its own pixels, that an
    element other than a caption covers and that is whitened. Both sides meet on columns ``size`` wide."""
    cols = [*keys, "det_id", "label", *BOX]

    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*(F.col(c).alias(f"{p}{c}") for c in cols))
        return named.withColumn(f"{p}bin", F.explode(F.sequence(F.floor(F.col(f"{p}x1") / size), F.greatest(F.floor(F.col(f"{p}x1") / size), F.floor(F.col(f"{p}x2") / size)))))

    on = [F.col(f"t_{k}") == F.col(f"e_{k}") for k in keys] + [F.col("t_bin") == F.col("e_bin")]
    j = side(targets, "t_").join(side(elements, "e_"), on).where(F.col("t_bin") == F.greatest(F.floor(F.col("t_x1") / size), F.floor(F.col("e_x1") / size)))
    over = F.least("t_x2", "e_x2") - F.greatest("t_x1", "e_x1")
    meets = g.intersection("t_", "e_") > 0
    above = (F.col("e_label") == "text") & (over > 0.5 * F.least(F.col("t_x2") - F.col("t_x1"), F.col("e_x2") - F.col("e_x1")))
    label = F.when((F.col("e_label") == "text") & (F.col("e_y1") >= F.col("t_y2") - 20), "caption").otherwise(F.col("e_label"))
    masked = meets & (label != "caption")
    rel = lambda f, c: (f(f"t_{c}", f"e_{c}") - F.col(f"t_{c[0]}1")).alias(c)
    mask = F.when(masked, F.struct(rel(F.greatest, "x1"), rel(F.greatest, "y1"), rel(F.least, "x2"), rel(F.least, "y2")))
    p = j.where(meets | above).select(F.col("t_det_id").alias("target_id"), F.col("e_det_id").alias("element_id"), label.alias("label"), masked.alias("masked"), mask.alias("mask"))
    return p.withColumn("elem_idx", (F.row_number().over(W.partitionBy("target_id", "label").orderBy("element_id")) - 1).cast("int"))


def outcome(tables_: DataFrame, cells: DataFrame) -> DataFrame:
    """is_valid and reason of each table (columns accepted, readable): why it has no grid, or an empty reason."""
    have = cells.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("cells_"), F.count_if(F.coalesce(F.col("content"), F.lit("")) != "").alias("texts_"))
    reason = (
        F.when(~F.coalesce("accepted", F.lit(False)), "Filtered by YOLO").when(~F.coalesce("readable", F.lit(False)), "Image read error")
        .when(F.coalesce("cells_", F.lit(0)) == 0, "No cells detected").when(F.col("texts_") == 0, "No content extracted").otherwise("")
    )
    return tables_.join(have, TABLE, "left").select(*TABLE, (reason == "").alias("is_valid"), reason.alias("reason"))


def sequential(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of a column without gathering all rows: rows are sorted by range, numbered
    within each partition and moved by the counts of the partitions before. The sorted rows are cut through the
    checkpoint folder, for partitions must be the same in both passes."""
    parts = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part_", F.spark_partition_id()))
    counts = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")).alias("before_"))
    local = parts.withColumn("k_", F.row_number().over(W.partitionBy("part_").orderBy(order)))
    return local.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("k_") - 1 + start).drop("part_", "k_", "before_")
