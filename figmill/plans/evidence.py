"""Queries over evidence packets, raw packets and documents, each with reference SQL where it can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.functions import values as v
from figmill.operators import evidence
from figmill.operators.tables import stacked
from figmill.operators.knowledge import prompt, replies
from figmill.session import looked_up, table
from figmill.sources import files, recorded, seams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_ONE = "SELECT packet_id, paper_id, meta.figure_id AS figure_id, '{f}' AS field, CAST(i - 1 AS INTEGER) AS item_no, x.text AS text, x.source_file AS source_file, x.note AS note FROM (SELECT packet_id, paper_id, meta, unnest(text_evidence.{f}) AS x, unnest(range(1, len(text_evidence.{f}) + 1)) AS i FROM evidence_packets)"
ITEMS = "items AS (" + " UNION ALL ".join(_ONE.format(f=f) for f in evidence.FIELDS) + ")"
_L = "list_filter(list_transform(text_evidence.{f}, lambda x: x.text), lambda t: t IS NOT NULL)"
_ALL = " || ".join(f"coalesce(array_to_string({_L.format(f=f)}, ''), '')" for f in evidence.FIELDS)
_REL = "(" + " OR ".join(f"contains(regexp_replace(lower({{t}}), '[^a-z0-9]', '', 'g'), '{k}')" for k in v.KEYWORDS) + ")"
_VALID = "(length({t}) >= 2 AND NOT regexp_matches(replace({t}, '.', ''), '^[0-9]+$'))"


def packets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_packets")


def items(spark: SparkSession, d: str) -> DataFrame:
    return evidence.text_items(packets(spark, d))


# --- text items -----------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT packet_id, field, item_no, CASE WHEN contains(source_file, 'x_axis_title') THEN 'x_axis_title' WHEN contains(source_file, 'y_axis_title') THEN 'y_axis_title' WHEN contains(source_file, 'chart_text') THEN 'chart_text' WHEN contains(source_file, 'caption') THEN 'chart_text' WHEN contains(source_file, 'legend') THEN 'legend_text' END AS kind FROM items WHERE source_file IS NOT NULL")
def crop_scan(spark, d):
    return items(spark, d).where("source_file is not null").select("packet_id", "field", "item_no", v.crop_kind(F.col("source_file")).alias("kind"))


@query(f"WITH {ITEMS} SELECT packet_id, field, item_no FROM items WHERE {_VALID.format(t='text')}")
def valid_text(spark, d):
    return items(spark, d).where(v.is_evidence(F.col("text"))).select("packet_id", "field", "item_no")


@query(f"SELECT packet_id, {_REL.format(t='(' + _ALL + ')')} AS relevant FROM evidence_packets")
def relevance(spark, d):
    return evidence.relevance(packets(spark, d))


@query(f"SELECT packet_id, coalesce(array_to_string({_L.format(f='chart_text')}, '. '), '') AS caption FROM evidence_packets")
def caption_concat(spark, d):
    return packets(spark, d).select("packet_id", F.coalesce(F.array_join(evidence.field_texts("chart_text"), ". "), F.lit("")).alias("caption"))


@query(
    """SELECT packet_id, coalesce((SELECT string_agg(trim(l), ' ' ORDER BY k) FROM (SELECT l, k, bool_or(regexp_matches(lower(trim(l)), '^(fig|scheme|table)')) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS on_
    FROM (SELECT unnest(string_split(coalesce(meta.caption, ''), chr(10))) AS l, unnest(range(0, len(string_split(coalesce(meta.caption, ''), chr(10))))) AS k)) WHERE on_), '') AS caption FROM evidence_packets"""
)
def caption_lines(spark, d):
    return evidence.caption_lines(packets(spark, d))


@query("SELECT packet_id, CASE WHEN coalesce(meta.caption, '') = '' THEN 'Forced caption of ' || coalesce(meta.figure_id, '') ELSE meta.caption END AS caption FROM evidence_packets")
def forced_caption(spark, d):
    """Packets without a caption are forced to take one."""
    p = packets(spark, d)
    forced = p.where(F.coalesce("meta.caption", F.lit("")) == "").select("packet_id", F.concat(F.lit("Forced caption of "), F.coalesce("meta.figure_id", F.lit(""))).alias("caption"))
    return evidence.forced_caption(p, forced).select("packet_id", F.col("meta.caption").alias("caption"))


_PAGE = "array_to_string(list_slice(string_split({f}, '_'), 1, 2), '_')"


@query(
    f"""WITH caps AS (SELECT paper_id, {_PAGE.format(f='meta.figure_id')} AS page, meta.figure_id AS owner, min(meta.caption) AS text FROM evidence_packets WHERE {_VALID.format(t='meta.caption')} GROUP BY ALL),
    need AS (SELECT packet_id, paper_id, meta.figure_id AS figure_id, {_PAGE.format(f='meta.figure_id')} AS page FROM evidence_packets WHERE NOT {_REL.format(t='(' + _ALL + ')')})
    SELECT packet_id, text, owner AS source_file, 'Shared Caption Fallback' AS note FROM need JOIN caps ON need.paper_id = caps.paper_id AND need.page = caps.page AND need.figure_id <> caps.owner QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY owner, text) = 1"""
)
def caption_fallback(spark, d):
    return evidence.caption_fallback(packets(spark, d))


@query(
    f"""WITH {ITEMS}, w AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+')), '.,;:()[]{{}}') AS term FROM items WHERE text IS NOT NULL)
    SELECT term FROM w WHERE term <> '' AND lower(term) NOT IN ({", ".join("'" + s + "'" for s in v.STOP_WORDS)}) AND NOT regexp_matches(replace(term, '.', ''), '^[0-9]+$') AND (length(term) >= 2 OR (upper(term) = term AND lower(term) <> term))"""
)
def harvest_terms(spark, d):
    return evidence.terms(items(spark, d))


_NAMES = "names AS (SELECT series_name AS term, 'series ' || CAST(name_id AS VARCHAR) AS \"full\" FROM series_names)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "series_names").select(F.col("series_name").alias("term"), F.concat(F.lit("series "), F.col("name_id").cast("string")).alias("full"))


@query(f"WITH {ITEMS}, {_NAMES} SELECT packet_id, item_no, CASE WHEN \"full\" IS NOT NULL THEN text || ' (' || \"full\" || ')' ELSE text END AS text FROM items LEFT JOIN names ON text = term WHERE field = 'legend_text'")
def term_resolve(spark, d):
    j = looked_up(items(spark, d).where("field = 'legend_text'"), _names(spark, d).withColumnRenamed("term", "text"), "text")
    return j.select("packet_id", "item_no", evidence.resolved(F.col("text"), F.col("full")).alias("text"))


_TITLE = "CASE WHEN len({l}) > 0 THEN list_sort({l})[1].t ELSE '{d}' END"
_TL = "list_transform(list_filter(text_evidence.{f}, lambda x: x.text IS NOT NULL), lambda x: {{'s': coalesce(x.source_file, ''), 't': x.text}})"
_TX, _TY = (_TITLE.format(l=_TL.format(f=f), d=n) for f, n in (("x_axis_title", "X-Axis"), ("y_axis_title", "Y-Axis")))


@query(f"SELECT packet_id, {_TX} AS x_title, {_TY} AS y_title FROM evidence_packets")
def axis_titles(spark, d):
    return evidence.axis_titles(packets(spark, d))


_N = "CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_PTS = f"pts AS (SELECT packet_id, CAST(i - 1 AS INTEGER) AS point_no, p.Series AS series, {_N.format(c='p.X')} AS x, {_N.format(c='p.Y_Left')} AS y_left, {_N.format(c='p.Y_Right')} AS y_right FROM (SELECT packet_id, unnest(raw_data) AS p, unnest(range(1, len(raw_data) + 1)) AS i FROM evidence_packets))"


@query(f"WITH {_PTS} SELECT * FROM pts")
def packet_points(spark, d):
    return evidence.points(packets(spark, d))


_FLAT = ", ".join("'{f}: ' || coalesce(array_to_string(list_transform(text_evidence.{f}, lambda x: '<' || coalesce(x.text, '') || '|' || coalesce(x.source_file, '') || '|' || coalesce(x.note, '') || '>'), ''), '') AS {f}".format(f=f) for f in evidence.FIELDS)


@query(f"SELECT packet_id, {_FLAT}, CAST(coalesce(len(raw_data), 0) AS INTEGER) AS points, coalesce(array_to_string(list_transform(raw_data, lambda p: coalesce(p.Series, '') || '/' || CASE WHEN p.X IS NULL OR isnan(p.X) THEN '' ELSE CAST(CAST(round(p.X * 1000) AS BIGINT) AS VARCHAR) END), ' '), '') AS values FROM evidence_packets")
def packet_nested(spark, d):
    """Items and points flattened and gathered into nested packets again; every text, file and note, and every point, must stand where it stood."""
    nested = evidence.nested(packets(spark, d).select("packet_id"), items(spark, d), evidence.points(packets(spark, d)))
    one = lambda x: F.concat(F.lit("<"), F.coalesce(x["text"], F.lit("")), F.lit("|"), F.coalesce(x["source_file"], F.lit("")), F.lit("|"), F.coalesce(x["note"], F.lit("")), F.lit(">"))
    flat = lambda f: F.concat(F.lit(f"{f}: "), F.array_join(F.transform(f, one), "")).alias(f)
    point = lambda p: F.concat(F.coalesce(p["series"], F.lit("")), F.lit("/"), F.coalesce(F.round(p["x"] * 1000).cast("long").cast("string"), F.lit("")))
    return nested.select("packet_id", *map(flat, evidence.FIELDS), F.size("raw_data").alias("points"), F.array_join(F.transform("raw_data", point), " ").alias("values"))


_CONDITIONS = {"Solvent": "toluene", "Scale": "lab"}


@query(
    f"""WITH {_PTS}, {_NAMES}, ti AS (SELECT packet_id, {_TX} AS x_title, {_TY} AS y_title FROM evidence_packets), j AS (SELECT * FROM pts JOIN ti USING (packet_id) LEFT JOIN names ON series = term)
    SELECT packet_id, point_no, 'Series' AS attr, CASE WHEN "full" IS NOT NULL THEN series || ' (' || "full" || ')' ELSE coalesce(series, 'Unknown') END AS value, NULL::DOUBLE AS number FROM j
    UNION ALL SELECT packet_id, point_no, x_title, NULL, x FROM j UNION ALL SELECT packet_id, point_no, y_title, NULL, y_left FROM j
    UNION ALL SELECT packet_id, point_no, 'Condition: Solvent', 'toluene', NULL FROM j UNION ALL SELECT packet_id, point_no, 'Condition: Scale', 'lab', NULL FROM j
    UNION ALL SELECT packet_id, point_no, 'Data_Value', NULL, y_right FROM j WHERE y_right IS NOT NULL"""
)
def fuse_long(spark, d):
    return evidence.fused(packets(spark, d), _names(spark, d), _CONDITIONS)


@query(
    f"""WITH {_PTS}, know AS (SELECT paper_id, count(*) AS n FROM documents WHERE paper_id IS NOT NULL GROUP BY ALL), ti AS (SELECT packet_id, paper_id, meta.figure_id AS figure_id, {_TX} AS x_title, {_TY} AS y_title FROM evidence_packets),
    j AS (SELECT ti.*, pts.* EXCLUDE (packet_id), know.n FROM pts JOIN ti USING (packet_id) LEFT JOIN know ON ti.paper_id = know.paper_id),
    c AS (SELECT packet_id, point_no, figure_id, unnest([{{'k': 'Series', 'v': CASE WHEN coalesce(series, 'Unknown') = 'Unknown' AND n IS NOT NULL THEN 'Unknown (not read)' ELSE coalesce(series, 'Unknown') END, 'o': 0}}, {{'k': x_title, 'v': CAST(x AS VARCHAR), 'o': 1}}, {{'k': y_title, 'v': CAST(y_left AS VARCHAR), 'o': 2}},
      {{'k': 'Data_Value', 'v': CAST(y_right AS VARCHAR), 'o': 3}}, {{'k': 'Condition: Documents', 'v': CAST(n AS VARCHAR), 'o': 4}}]) AS e FROM j),
    f AS (SELECT packet_id, point_no, figure_id, e.k AS col, arg_max(coalesce(e.v, ''), e.o) AS cell FROM c WHERE NOT (e.o IN (3, 4) AND e.v IS NULL) GROUP BY ALL)
    SELECT packet_id, point_no, figure_id, col, CASE WHEN col = 'Series' OR starts_with(col, 'Condition') THEN cell END AS cell, CASE WHEN NOT (col = 'Series' OR starts_with(col, 'Condition')) THEN try_cast(cell AS DOUBLE) END AS number FROM f"""
)
def fuse_wide(spark, d):
    """The cells of each figure's wide table; the knowledge of a paper is a recorded reply."""
    reply = F.concat(F.lit('{"term_mapping": {"Unknown": "not read"}, "global_conditions": {"Documents": "'), F.col("n").cast("string"), F.lit('"}}'))
    known = replies(table(spark, d, "documents").where("paper_id is not null").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).select("paper_id", reply.alias("reply")), "paper_id")
    cells = evidence.fused_wide(packets(spark, d), known).select("packet_id", "point_no", "figure_id", F.explode("row").alias("col", "cell"))
    plain = (F.col("col") == "Series") | F.col("col").startswith("Condition")
    return cells.select("packet_id", "point_no", "figure_id", "col", F.when(plain, F.col("cell")).alias("cell"), F.when(~plain, F.col("cell").try_cast("double")).alias("number"))


# --- raw packets ------------------------------------------------------------------


@query("SELECT file_id, paper_id, regexp_extract(file_name, '(page_[0-9]+)_', 1) AS page, regexp_replace(file_name, '^.*/', '') AS base, regexp_replace(replace(file_name, '_evidence.json', ''), '^.*/', '') AS figure FROM raw_packets")
def id_parse(spark, d):
    f = F.col("file_name")
    return table(spark, d, "raw_packets").select("file_id", "paper_id", v.page_of_file(f).alias("page"), v.base_name(f).alias("base"), v.figure_of_file(f).alias("figure"))


_JSON = "try_cast(regexp_replace(payload, '\\bNaN\\b', 'null', 'g') AS JSON)"
#: A packet is an object with a meta, a text_evidence or a raw_data; it is the payload, in its list, or in a list of its wrapper.
_IS = "(json_type({x}, '$.meta') IS NOT NULL OR json_type({x}, '$.text_evidence') IS NOT NULL OR json_type({x}, '$.raw_data') IS NOT NULL)"
_LISTS = "list_transform(json_keys(j), lambda k: json_extract(j, '$.\"' || k || '\"'))"
_ROOT = f"""raw0 AS (SELECT file_id, {_JSON} AS j FROM raw_packets), lists AS (SELECT file_id, j, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j) = 'OBJECT' AND {_IS.format(x='j')} THEN [j]
      WHEN json_type(j) = 'OBJECT' THEN flatten(list_transform(list_filter({_LISTS}, lambda v: json_type(v) = 'ARRAY'), lambda v: CAST(v AS JSON[]))) END AS rows_ FROM raw0 WHERE j IS NOT NULL)"""


@query(
    f"""WITH {_ROOT}, p AS (SELECT file_id, unnest(list_filter(rows_, lambda x: json_type(x) = 'OBJECT' AND {_IS.format(x='x')})) AS x FROM lists)
    SELECT file_id, CASE WHEN json_type(x, '$.meta') = 'OBJECT' THEN json_extract_string(x, '$.meta.figure_id') END AS figure_id, CASE WHEN json_type(x, '$.raw_data') = 'ARRAY' THEN CAST(json_array_length(x, '$.raw_data') AS INTEGER) END AS points FROM p"""
)
def evidence_scan(spark, d):
    """The packets of every file, in whatever wrapper."""
    one = F.col("packet")
    return recorded.packets(table(spark, d, "raw_packets")).select("file_id", one["meta"]["figure_id"].alias("figure_id"), F.when(one["raw_data"].isNotNull(), F.size(one["raw_data"])).alias("points"))


_NUM = "CASE WHEN json_type(x, '$.\"{k}\"') IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT') THEN CAST(json_extract(x, '$.\"{k}\"') AS DOUBLE) END"


@query(
    f"""WITH {_ROOT}, p AS (SELECT file_id, unnest(list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'OBJECT')) AS x FROM raw0 WHERE json_type(j) = 'ARRAY' AND len(list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND {_IS.format(x='x')})) = 0)
    SELECT file_id, CAST(count(*) AS INTEGER) AS points, count({_NUM.format(k='X')}) AS with_x, round(sum({_NUM.format(k='X')}), 5) AS x FROM p GROUP BY file_id"""
)
def points_scan(spark, d):
    """The points of every file that holds mapped points alone, whatever their fields."""
    return recorded.mapped_points(table(spark, d, "raw_packets")).groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("points"), F.count("x").alias("with_x"), F.round(F.sum("x"), 5).alias("x"))


_LOG = "'start' || chr(10) || '---JSON_START---' || chr(10) || payload || chr(10) || '---JSON_END---' || chr(10) || 'end'"


@query(f"SELECT file_id, length(trim(regexp_extract({_LOG}, '(?s)---JSON_START---(.*?)---JSON_END---', 1), chr(10) || chr(13) || chr(9) || ' ')) AS n FROM raw_packets WHERE payload IS NOT NULL")
def sentinel_json(spark, d):
    log = F.concat(F.lit("start\n---JSON_START---\n"), F.col("payload"), F.lit("\n---JSON_END---\nend"))
    return table(spark, d, "raw_packets").where("payload is not null").select("file_id", F.length(v.sentinel(log)).cast("long").alias("n"))


@query("SELECT file_id, coalesce(json_valid(regexp_replace(payload, '\\bNaN\\b', 'null', 'g')), false) AS valid FROM raw_packets")
def clean_json(spark, d):
    """Replies in a Markdown fence, parsed; what doesn't parse falls back to an empty result."""
    fenced = F.concat(F.lit("```json\n"), F.col("payload"), F.lit("\n```"))
    parsed = F.try_parse_json(F.regexp_replace(v.clean_json(fenced), r"\bNaN\b", "null"))
    return table(spark, d, "raw_packets").select("file_id", F.coalesce(parsed.isNotNull(), F.lit(False)).alias("valid"))


_DIR, _BASE = "regexp_replace(file_name, '/[^/]*$', '')", "regexp_replace(file_name, '^.*/', '')"


@query(
    f"""WITH n AS (SELECT DISTINCT paper_id AS name FROM documents WHERE paper_id <> '' UNION SELECT 'page_' || CAST(i AS VARCHAR) FROM range(1, 9) r(i)), d AS (SELECT name, file_id FROM n JOIN raw_packets ON contains('/' || {_DIR} || '/', '/' || name || '/') OR starts_with({_BASE} || '_', name || '_')),
    f AS (SELECT name, file_id FROM n JOIN raw_packets ON starts_with({_BASE}, 'page_') AND split_part(file_name, '/', 1) = name WHERE name NOT IN (SELECT name FROM d))
    SELECT name, count(*) AS files, count(DISTINCT file_id) AS distinct_files, false AS fallback FROM d GROUP BY name UNION ALL SELECT name, count(*), count(DISTINCT file_id), true FROM f GROUP BY name"""
)
def doc_link(spark, d):
    """Files of each document, and of names that are the start of file names."""
    names = table(spark, d, "documents").select(F.col("paper_id").alias("name")).unionByName(spark.range(1, 9).select(F.concat(F.lit("page_"), F.col("id").cast("string")).alias("name")))
    files = table(spark, d, "raw_packets").select("file_id", "file_name", F.regexp_replace("file_name", "/[^/]*$", "").alias("source_dir"))
    return evidence.linked(names, files).groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("file_id").alias("distinct_files"), F.max("fallback").alias("fallback"))


@query("SELECT paper_id, count(*) AS files, count(*) FILTER (payload IS NULL OR payload = '') AS empty, strftime(max(arrived_at), '%Y-%m-%d %H:%M:%S') AS last FROM raw_packets GROUP BY ALL")
def run_manifest(spark, d):
    return table(spark, d, "raw_packets").groupBy("paper_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("payload").isNull() | (F.col("payload") == "")).alias("empty"), F.date_format(F.max("arrived_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


# --- documents and paths ------------------------------------------------------------


@query("SELECT doc_id, length(substr(text, 1, 500)) AS head, length(substr(text, 1, 100000)) AS body FROM documents WHERE text IS NOT NULL")
def truncate_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(F.substring("text", 1, 500)).cast("long").alias("head"), F.length(F.substring("text", 1, 100000)).cast("long").alias("body"))


@query("SELECT doc_id, 'Terms: ' || array_to_string(list_sort([coalesce(section, 'none'), coalesce(lang, 'none')]), ', ') || chr(10) || 'Text: ' || substr(coalesce(text, ''), 1, 100000) AS prompt FROM documents")
def prompt_build(spark, d):
    terms = F.array(F.coalesce("section", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return table(spark, d, "documents").select("doc_id", prompt(terms, F.col("text")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN length(text) END AS length, CASE WHEN trim(text) = '' THEN 'nothing to read' END AS error FROM documents WHERE text IS NOT NULL")
def seam_adapter(spark, d):
    """A model behind a seam, here one that measures a text; a row that it fails on keeps its error."""

    def opened():
        def model(text: str) -> list[dict]:
            if not text.strip(" "):
                raise ValueError("nothing to read")
            return [{"length": len(text)}]

        return model

    return seams.Adapter(opened, "length long").apply(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"WITH {ITEMS} SELECT packet_id, field, item_no, text FROM items WHERE packet_id IN (SELECT packet_id FROM evidence_packets WHERE meta.caption IS NOT NULL)")
def seam_recorded(spark, d):
    """Recorded outputs in place of a model, for the packets that ask for them."""
    return seams.recorded(packets(spark, d).where("meta.caption is not null"), items(spark, d), "packet_id").select("packet_id", "field", "item_no", "text")


@query(f"WITH {ITEMS} SELECT packet_id, string_agg(text, chr(10) ORDER BY field, item_no) AS text FROM items WHERE text IS NOT NULL GROUP BY packet_id")
def doc_fulltext(spark, d):
    """The texts of a packet, one line each, in order."""
    parts = items(spark, d).where("text is not null").groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("field", "item_no", "text"))).alias("p"))
    return parts.select("packet_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


@query(f"SELECT packet_id, coalesce({_L.format(f='legend_text')}[1], '') AS first_text, coalesce(array_to_string({_L.format(f='legend_text')}, ' '), '') AS all_text FROM evidence_packets WHERE text_evidence.legend_text IS NOT NULL")
def ocr_normalize(spark, d):
    """Recognition results of both producers, as JSON, in one form: the first text and all texts."""
    raw = packets(spark, d).where("text_evidence.legend_text is not null").select("packet_id", evidence.field_texts("legend_text").alias("t"))
    boxes = F.array(F.array(F.lit(0.0), F.lit(0.0)))
    one = F.to_json(F.array(F.struct(F.col("t").alias("rec_texts"))))
    other = F.to_json(F.array(F.transform("t", lambda x: F.array(F.to_json(boxes), F.to_json(F.array(x, F.lit("0.9")))))))
    result = raw.select("packet_id", F.when(F.col("packet_id") % 2 == 0, one).otherwise(other).alias("json"))
    return result.select("packet_id", recorded.first_text(F.col("json")).alias("first_text"), recorded.all_texts(F.col("json")).alias("all_text"))


@query(f"WITH {ITEMS} SELECT packet_id, field, item_no, CASE WHEN ends_with(lower(source_file), '.png') THEN 'image/png' WHEN ends_with(lower(source_file), '.webp') THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM items WHERE source_file IS NOT NULL")
def mime_type(spark, d):
    return items(spark, d).where("source_file is not null").select("packet_id", "field", "item_no", v.mime_type(F.col("source_file")).alias("mime"))


@query(f"WITH {ITEMS} SELECT packet_id, field, item_no, 'data:' || CASE WHEN ends_with(lower(source_file), '.png') THEN 'image/png' WHEN ends_with(lower(source_file), '.webp') THEN 'image/webp' ELSE 'image/jpeg' END || ';base64,' || to_base64(encode(coalesce(text, ''))) AS uri FROM items WHERE source_file IS NOT NULL")
def data_uri(spark, d):
    """Images as data URIs; an item's text stands for the bytes of its image."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return items(spark, d).where("source_file is not null").select("packet_id", "field", "item_no", files.data_uri(F.col("source_file"), content).alias("uri"))


@query(f"WITH {ITEMS} SELECT DISTINCT source_file FROM items WHERE regexp_matches(lower(source_file), '\\.(png|jpe?g)$')")
def ext_filter(spark, d):
    return items(spark, d).where(F.col("source_file").rlike(r"(?i)\.(png|jpe?g)$")).select("source_file").distinct()


@query(f"WITH {ITEMS} SELECT DISTINCT source_file FROM items WHERE contains(source_file, 'title') AND NOT contains(source_file, 'y_axis')")
def name_filter(spark, d):
    f = F.col("source_file")
    return items(spark, d).where(f.contains("title") & ~f.contains("y_axis")).select("source_file").distinct()


@query("SELECT file_id, regexp_replace(file_name, '^([^/]+)/(.*)$', 'evidence/\\1_\\2') AS path, 'lab_pub_' || regexp_replace(file_name, '^.*/', '') AS copy FROM raw_packets WHERE NOT contains(file_name, '_extraction') AND NOT contains(file_name, '_9_')")
def path_rename(spark, d):
    return files.gathered(table(spark, d, "raw_packets"), "evidence", "lab_pub_", ["_extraction", "_9_"]).select("file_id", "path", "copy")


@query("SELECT cell_id, list_count(list_filter(string_split('Cell ' || CAST(cell_idx AS VARCHAR) || ' [' || coalesce(content, '') || ']:' || chr(10) || coalesce(content, ''), chr(10)), lambda l: contains(l, 'Cell ') AND contains(l, ']:'))) AS lines FROM table_cells")
def log_lines(spark, d):
    log = F.concat(F.lit("Cell "), F.col("cell_idx").cast("string"), F.lit(" ["), F.coalesce("content", F.lit("")), F.lit("]:\n"), F.coalesce("content", F.lit("")))
    kept = F.filter(F.split(log, "\n"), lambda x: x.contains("Cell ") & x.contains("]:"))
    return table(spark, d, "table_cells").select("cell_id", F.size(kept).cast("long").alias("lines"))


@query(f"SELECT packet_id, coalesce(array_to_string({_L.format(f='chart_text')}, ' '), '') AS reply FROM evidence_packets")
def reply_join(spark, d):
    parts = F.coalesce(F.filter("text_evidence.chart_text", lambda x: x["text"].isNotNull()), F.array().cast("array<struct<text: string, source_file: string, note: string>>"))
    return packets(spark, d).select("packet_id", F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("reply"))


@query(f"WITH {ITEMS}, l AS (SELECT packet_id, item_no, 20 + length(coalesce(text, '')) % 13 AS h FROM items WHERE field = 'legend_text') SELECT packet_id, item_no, CAST(coalesce(sum(h + 10) OVER (PARTITION BY packet_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM l")
def stack_offsets(spark, d):
    h = items(spark, d).where("field = 'legend_text'").select("packet_id", "item_no", (F.length(F.coalesce("text", F.lit(""))) % 13 + 20).alias("h"))
    return stacked(h, ["packet_id"], "item_no", "h").select("packet_id", "item_no", "y_offset")
