"""Operators on evidence packets: text items, relevance, captions, points, terms and fusion.

Edge cases: null arrays and items count as empty; null texts are no evidence; NaN in a
value is read as null; repeated packets are rows of their own packet_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from figmill.functions import values as v
from figmill.session import looked_up

FIELDS = ["x_axis_title", "y_axis_title", "chart_text", "legend_text"]
NOTE = "Shared Caption Fallback"


def text_items(packets: DataFrame) -> DataFrame:
    """packet_id, paper_id, figure_id, field, item_no, text, source_file, note: the items of the four arrays."""
    parts = []
    for f in FIELDS:
        name = F.lit(f).alias("field")
        one = F.transform(f"text_evidence.{f}", lambda x, i: F.struct(name, i.alias("item_no"), x["text"].alias("text"), x["source_file"].alias("source_file"), x["note"].alias("note")))  # noqa: B023
        parts.append(F.coalesce(one, F.array().cast("array<struct<field: string, item_no: int, text: string, source_file: string, note: string>>")))
    return packets.select("packet_id", "paper_id", F.col("meta.figure_id").alias("figure_id"), F.explode(F.concat(*parts)).alias("i")).select("packet_id", "paper_id", "figure_id", "i.*")


def field_texts(f: str) -> Column:
    """The texts of a field that aren't null; only this leaf of the nested column is read."""
    return F.filter(F.col(f"text_evidence.{f}.text"), lambda t: t.isNotNull())


def all_text() -> Column:
    """All texts of a packet in one string."""
    return F.concat(*(F.coalesce(F.array_join(field_texts(f), ""), F.lit("")) for f in FIELDS))


def relevance(packets: DataFrame) -> DataFrame:
    """relevant: does any text of the packet speak of a result?"""
    return packets.select("packet_id", v.is_relevant(all_text()).alias("relevant"))


def page_of(figure: Column) -> Column:
    """The page part of a figure id."""
    return F.substring_index(figure, "_", 2)


def caption_fallback(packets: DataFrame) -> DataFrame:
    """packet_id, text, source_file, note: for packets without a result word, the first caption (by figure) of another
    figure on the same page of the paper. The best caption of each page is found first, with a runner-up for the figure
    that owns it, so nothing but two captions a page is joined."""
    caps = packets.where(v.is_evidence(F.col("meta.caption"))).select("paper_id", page_of(F.col("meta.figure_id")).alias("page"), F.col("meta.figure_id").alias("owner"), F.col("meta.caption").alias("text"))
    each = caps.groupBy("paper_id", "page", "owner").agg(F.min("text").alias("text"))
    first = each.groupBy("paper_id", "page").agg(F.min(F.struct("owner", "text")).alias("one"))
    second = each.join(first, ["paper_id", "page"]).where("owner <> one.owner").groupBy("paper_id", "page").agg(F.min(F.struct("owner", "text")).alias("two"))
    best = first.join(second, ["paper_id", "page"], "left")
    need = packets.where(~v.is_relevant(all_text())).select("packet_id", "paper_id", F.col("meta.figure_id").alias("figure_id"), page_of(F.col("meta.figure_id")).alias("page"))
    pick = F.when(F.col("one.owner") != F.col("figure_id"), F.col("one")).otherwise(F.col("two"))
    return need.join(best, ["paper_id", "page"]).withColumn("pick", pick).where("pick is not null").select("packet_id", F.col("pick.text").alias("text"), F.col("pick.owner").alias("source_file"), F.lit(NOTE).alias("note"))


def caption_lines(packets: DataFrame) -> DataFrame:
    """caption: the lines of a caption from the first that starts one (figure, scheme, table); empty if none does."""
    lines = F.split(F.coalesce(F.col("meta.caption"), F.lit("")), "\n")
    starts = lambda x: F.lower(F.btrim(x)).rlike("^(fig|scheme|table)")
    at = F.array_position(F.transform(lines, starts), True)
    kept = F.when(at > 0, F.slice(lines, F.greatest(at.cast("int"), F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    return packets.select("packet_id", F.array_join(F.transform(kept, lambda x: F.btrim(x)), " ").alias("caption"))


def points(packets: DataFrame) -> DataFrame:
    """packet_id, point_no, series, x, y_left, y_right: the points of every packet."""
    num = lambda k: F.nanvl(F.col(f"p.{k}"), F.lit(None).cast("double"))
    return packets.select("packet_id", F.posexplode("raw_data").alias("point_no", "p")).select("packet_id", "point_no", F.col("p.Series").alias("series"), num("X").alias("x"), num("Y_Left").alias("y_left"), num("Y_Right").alias("y_right"))


def nested(packets: DataFrame, items: DataFrame, points_: DataFrame) -> DataFrame:
    """packet_id, the four arrays of items and raw_data: flat items and points gathered into one row per packet, in order.

    A packet without items or points has empty arrays. ``packets`` has one row per packet_id."""
    per = items.groupBy("packet_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("item_no", "text", "source_file", "note")))).alias(f) for f in FIELDS))
    pts = points_.groupBy("packet_id").agg(F.sort_array(F.collect_list(F.struct("point_no", "series", "x", "y_left", "y_right"))).alias("raw_data"))
    j = packets.join(per, "packet_id", "left").join(pts, "packet_id", "left")
    kinds = dict(j.dtypes)
    return j.select(*packets.columns, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in (*FIELDS, "raw_data")))


def terms(items: DataFrame) -> DataFrame:
    """term: the distinct candidate abbreviations of all texts (column text)."""
    words = items.select(F.explode(F.split(F.btrim("text"), r"\s+")).alias("w")).select(F.btrim("w", F.lit(v.TERM_EDGES)).alias("term")).where("term <> ''").distinct()
    number = F.replace(F.col("term"), F.lit("."), F.lit("")).rlike("^[0-9]+$")
    upper = (F.upper("term") == F.col("term")) & (F.lower("term") != F.col("term"))
    return words.where(~F.lower("term").isin(v.STOP_WORDS) & ~number & ((F.length("term") >= 2) | upper))


def resolved(text: Column, full: Column) -> Column:
    """A text with its meaning behind it, where it has one."""
    return F.when(full.isNotNull(), F.concat(text, F.lit(" ("), full, F.lit(")"))).otherwise(text)


def title_columns() -> list[Column]:
    """x_title, y_title: the first title of each axis in the order of the source files, from the packet's own arrays."""

    def first(f: str) -> Column:
        return F.element_at(F.sort_array(F.transform(F.filter(f"text_evidence.{f}", lambda x: x["text"].isNotNull()), lambda x: F.struct(F.coalesce(x["source_file"], F.lit("")).alias("s"), x["text"].alias("t")))), 1)["t"]

    has = lambda f: F.size(F.filter(f"text_evidence.{f}", lambda x: x["text"].isNotNull())) > 0
    title = lambda f, default: F.when(has(f), first(f)).otherwise(default)
    return [title("x_axis_title", "X-Axis").alias("x_title"), title("y_axis_title", "Y-Axis").alias("y_title")]


def axis_titles(packets: DataFrame) -> DataFrame:
    """x_title, y_title: the first title of each axis in the order of the source files."""
    return packets.select("packet_id", *title_columns())


def titled_points(packets: DataFrame) -> DataFrame:
    """packet_id, point_no, series, x, y_left, y_right, x_title, y_title: points with the titles of their own row; nothing is joined."""
    num = lambda k: F.nanvl(F.col(f"p.{k}"), F.lit(None).cast("double"))
    rows = packets.select("packet_id", *title_columns(), "raw_data").select("packet_id", "x_title", "y_title", F.posexplode("raw_data").alias("point_no", "p"))
    return rows.select("packet_id", "point_no", F.col("p.Series").alias("series"), num("X").alias("x"), num("Y_Left").alias("y_left"), num("Y_Right").alias("y_right"), "x_title", "y_title")


def fused(packets: DataFrame, names: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """packet_id, point_no, attr, value, number: points in long form (texts in value, numbers in number), columns named by the axis titles, names resolved, the
    global conditions on every point. ``names`` (term, full; one row per term) is looked up, by broadcast while it is small."""
    pts = looked_up(titled_points(packets), names.select(F.col("term").alias("series"), "full"), "series")
    none = F.lit(None).cast("string")
    text = lambda a, t: F.struct(a.alias("attr"), t.alias("value"), F.lit(None).cast("double").alias("number"))
    num = lambda a, c: F.struct(a.alias("attr"), none.alias("value"), c.alias("number"))
    attrs = [
        text(F.lit("Series"), resolved(F.coalesce("series", F.lit("Unknown")), F.col("full"))), num(F.col("x_title"), F.col("x")), num(F.col("y_title"), F.col("y_left")),
        *(text(F.lit(f"Condition: {k}"), F.lit(c)) for k, c in conditions.items()),
    ]
    data = F.when(F.col("y_right").isNotNull(), F.array(num(F.lit("Data_Value"), F.col("y_right")))).otherwise(F.array().cast("array<struct<attr: string, value: string, number: double>>"))
    return pts.select("packet_id", "point_no", F.explode(F.concat(F.array(*attrs), data)).alias("a")).select("packet_id", "point_no", "a.attr", "a.value", "a.number")


def fused_wide(packets: DataFrame, knowledge: DataFrame) -> DataFrame:
    """paper_id, figure_id, packet_id, point_no, row: one map of column to text for each point, as a line of the figure's own
    wide table: Series, the x title, the y title, Data_Value where there is one, and a column for each condition of the paper.

    Columns differ from figure to figure, so a row is a map (insertion order; of equal titles the later value holds).
    ``knowledge`` (paper_id, term_mapping, global_conditions) has one row per paper, as ``knowledge.replies`` gives."""
    base = packets.select("packet_id", "paper_id", F.col("meta.figure_id").alias("figure_id"), *title_columns(), "raw_data").select("packet_id", "paper_id", "figure_id", "x_title", "y_title", F.posexplode("raw_data").alias("point_no", "p"))
    j = looked_up(base, knowledge.select("paper_id", "term_mapping", "global_conditions"), "paper_id")
    num = lambda k: F.nanvl(F.col(f"p.{k}"), F.lit(None).cast("double")).cast("string")
    name = resolved(F.coalesce("p.Series", F.lit("Unknown")), F.try_element_at("term_mapping", F.coalesce("p.Series", F.lit("Unknown"))))
    cell = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = F.array(cell(F.lit("Series"), name), cell(F.col("x_title"), num("X")), cell(F.col("y_title"), num("Y_Left")))
    none = F.array().cast("array<struct<key: string, value: string>>")
    value = F.when(num("Y_Right").isNotNull(), F.array(cell(F.lit("Data_Value"), num("Y_Right")))).otherwise(none)
    given = F.coalesce(F.transform(F.map_entries("global_conditions"), lambda e: cell(F.concat(F.lit("Condition: "), e["key"]), e["value"])), none)
    cells = F.concat(own, value, given)
    # of cells with one name the last holds, at the place of the first
    names = F.array_distinct(F.transform(cells, lambda c: c["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(cells, lambda c: c["key"] == n), -1))
    return j.select("paper_id", "figure_id", "packet_id", "point_no", F.map_from_entries(last).alias("row"))


def linked(docs: DataFrame, files: DataFrame) -> DataFrame:
    """name, file_id, fallback: which files (file_id, file_name, source_dir) belong to which document (name).

    A file is linked if one of the folders of its source_dir is the document's name, or contains it between marks, or if its
    base name starts with it; where nothing is linked, by all files named page_* of the folder of that name, as fallback.
    Names meet files by equality of pieces (folders and their parts between _, - and blanks; starts of the base name), so
    there is no comparison of each document with each file."""
    base = F.element_at(F.split("file_name", "/"), -1)
    ends = F.filter(F.sequence(F.lit(1), F.length(base)), lambda i: (i == F.length(base)) | F.substring(base, i + 1, F.lit(1)).isin("_", "-", " ", "."))
    starts = F.transform(ends, lambda i: F.substring(base, F.lit(1), i))
    folders = F.split(F.coalesce("source_dir", F.lit("")), "/")
    parts = F.flatten(F.transform(folders, lambda x: F.split(x, "[_ -]")))
    names = docs.select("name").where("name <> ''").distinct()
    pieces = files.select("file_id", F.explode(F.array_distinct(F.concat(folders, parts, starts))).alias("name"))
    direct = pieces.join(names, "name")
    lone = names.join(direct.select("name").distinct(), "name", "left_anti")
    pages = files.where(base.startswith("page_")).select("file_id", F.element_at(F.split("file_name", "/"), 1).alias("name"))
    return direct.select("name", "file_id", F.lit(False).alias("fallback")).unionByName(pages.join(lone, "name").select("name", "file_id", F.lit(True).alias("fallback")))


def forced_caption(packets: DataFrame, forced: DataFrame) -> DataFrame:
    """Packets whose caption is replaced where ``forced`` (packet_id, caption) has one."""
    f = forced.where("caption is not null").select("packet_id", F.col("caption").alias("forced_"))
    return packets.join(f, "packet_id", "left").withColumn("meta", F.col("meta").withField("caption", F.coalesce("forced_", "meta.caption"))).drop("forced_")
