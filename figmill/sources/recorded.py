"""Readers of recorded outputs: evidence packets, mapped points and recognition results in JSON.

Bad input is null, never an error: an unreadable payload gives a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_ITEMS = "array<struct<text: string, source_file: string, note: string>>"
PACKET = f"meta struct<figure_id: string, source_intermediate_dir: string, caption: string>, text_evidence struct<x_axis_title: {_ITEMS}, y_axis_title: {_ITEMS}, chart_text: {_ITEMS}, legend_text: {_ITEMS}>, raw_data array<struct<Series: string, X: double, Y_Left: double, Y_Right: double, `Y_Right/Data_Value`: double>>"
POINTS = "array<struct<Series: string, X: double, Y_Left: double, Y_Right: double, `Y_Right/Data_Value`: double>>"


_PARTS = ["meta", "text_evidence", "raw_data"]


def _parsed(raw: DataFrame) -> DataFrame:
    """file_id, j: payloads as variants, bare NaN as null; null where they aren't complete JSON."""
    return raw.select("file_id", F.try_parse_json(F.regexp_replace("payload", r"\bNaN\b", "null")).alias("j")).where("j is not null")


def _part(x: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(x, f"$.{path}", kind)


def _is_packet(x: Column) -> Column:
    out = F.lit(False)
    for p in _PARTS:
        out = out | _part(x, p, "variant").isNotNull()
    return out


def _rows(j: Column) -> Column:
    """What may be packets: the payload, the elements of its list, or those of the lists of a wrapper."""
    one = F.try_variant_get(j, "$", "array<variant>")
    inside = F.flatten(F.transform(F.filter(F.map_values(F.try_variant_get(j, "$", "map<string, variant>")), lambda v: F.schema_of_variant(v).startswith("ARRAY")), lambda v: F.try_variant_get(v, "$", "array<variant>")))
    return F.when(one.isNotNull(), one).when(_is_packet(j), F.array(j)).otherwise(inside)


def packets(raw: DataFrame) -> DataFrame:
    """file_id, packet: every packet of every file with the packet's schema, wrappers removed; values of other types become null."""
    fields = [c.strip().split(" ", 1) for c in _top(PACKET)]
    rows = _parsed(raw).select("file_id", F.explode(F.filter(_rows(F.col("j")), _is_packet)).alias("x"))


    def field(name: str, kind: str) -> Column:
        v = _part(F.col("x"), name, "variant")
        return F.when(F.schema_of_variant(v).startswith("ARRAY" if kind.startswith("array") else "OBJECT"), F.from_json(F.to_json(v), kind)).alias(name)

    one = F.struct(*(field(*f) for f in fields))
    return rows.select("file_id", one.alias("packet"))


def _top(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def mapped_points(raw: DataFrame) -> DataFrame:
    """file_id, series, x, y_left, y_right: files that hold a list of points and no packet; the legacy column stands in for the
    current one, values of other types are null."""
    rows = _parsed(raw).select("file_id", F.try_variant_get("j", "$", "array<variant>").alias("p")).where("p is not null").where(~F.exists("p", _is_packet))
    point = rows.select("file_id", F.explode("p").alias("x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    x = F.col("x")
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(x, f'$["{k}"]', "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.nanvl(F.try_variant_get(x, f'$["{k}"]', "double"), F.lit(None).cast("double")))
    return point.select("file_id", _part(x, "Series", "string").alias("series"), number("X").alias("x"), number("Y_Left").alias("y_left"), F.coalesce(number("Y_Right/Data_Value"), number("Y_Right")).alias("y_right"))


def _texts(json: Column) -> Column:
    """All texts of a recognition result of either producer."""
    listed = F.get(F.from_json(json, "array<struct<rec_texts: array<string>>>"), F.lit(0))["rec_texts"]
    lines = F.get(F.from_json(json, "array<array<array<string>>>"), F.lit(0))
    nested = F.transform(lines, lambda line: F.get(F.from_json(F.get(line, F.lit(1)), "array<string>"), F.lit(0)))
    return F.coalesce(listed, nested, F.array().cast("array<string>"))


def first_text(json: Column) -> Column:
    return F.coalesce(F.try_element_at(_texts(json), F.lit(1)), F.lit(""))


def all_texts(json: Column) -> Column:
    return F.array_join(_texts(json), " ")
