"""Readers and writers of files: images, JSON packets and points, CSV, Parquet and manifests.

Names are columns, never a loop over files; unreadable files give rows with an error
or null, by the reader's permissive mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from figmill.functions.values import base_name, mime_type
from figmill.sources.recorded import PACKET, POINTS


def images(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """path, name, figure_id, content: image files below a folder; the figure is the name up to its last label part."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.regexp_extract(name, r"^(page_\d+_[a-z]+_\d+(?:_t\d+)?)", 1).alias("figure_id"), "length", "content")


def packet_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and the packet of every *_evidence.json file; a bad file gives null fields."""
    return spark.read.schema(PACKET).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*_evidence.json").option("recursiveFileLookup", "true").json(folder).select("*", F.col("_metadata.file_path").alias("path"))


def point_files(spark: SparkSession, folder: str, glob: str = "*_extraction.json") -> DataFrame:
    """path and one row per mapped point of each file."""
    schema = POINTS.removeprefix("array<struct<").removesuffix(">>").replace(": ", " ")
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", glob).json(folder).select("*", F.col("_metadata.file_path").alias("path"))


def csv_preview(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without a header, all columns as text."""
    return spark.read.csv(path, header=False)


def write_csv(df: DataFrame, path: str, header: bool = True, by: list[str] | None = None) -> None:
    """CSV with or without a header, in one folder per value of ``by``; nulls are empty."""
    w = df.write.mode("overwrite").option("nullValue", "")
    (w.partitionBy(*by) if by else w).csv(path, header=header)


def write_packets(packets: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Packets as JSON lines, null fields kept."""
    w = packets.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_fused(rows: DataFrame, path: str) -> None:
    """Wide points, one JSON object a line in the folder of their figure, whose columns are its own (rows of ``evidence.fused_wide``)."""
    lines = rows.select("paper_id", "figure_id", F.to_json("row", {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").partitionBy("paper_id", "figure_id").text(path)


def gathered(files_: DataFrame, folder: str, prefix: str = "", exclude: list[str] | None = None) -> DataFrame:
    """files_ (file_name, further columns) with path and copy: where each file goes when the files of all papers are brought
    into one folder, named by paper and file, and its name under a prefix. Names that contain one of ``exclude`` are left
    out. Only the plan of the moves is made: no file is touched."""
    f = F.col("file_name")
    kept = files_.where(f.isNotNull())
    for word in exclude or []:
        kept = kept.where(~f.contains(word))
    return kept.withColumns({"path": F.regexp_replace(f, "^([^/]+)/(.*)$", f"{folder}/$1_$2"), "copy": F.concat(F.lit(prefix), base_name(f))})


def data_uri(path: Column, content: Column) -> Column:
    """An image as a base64 data URI, its type by its name, without the line breaks of mail."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def coco_document(images_: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """part, value: the rows of an annotation document, one JSON object a line, by part (images, annotations, categories), and
    its totals (part info: images, annotations and categories counted). Lines are written in order of part and id, so a
    document of any size is a text file put together by its writer, not on the driver."""
    one = lambda df, part: df.select(F.lit(part).alias("part"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    parts = [one(images_, "images"), one(annotations, "annotations"), one(categories, "categories")]
    total = None
    for df, part in ((images_, "images"), (annotations, "annotations"), (categories, "categories")):
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("info").alias("part"), F.lit(0).cast("long").alias("id"), F.to_json(F.struct(F.lit(part).alias("of"), F.col("n").alias("total"))).alias("value"))
        total = n if total is None else total.unionByName(n)
    out = total
    for p in parts:
        out = out.unionByName(p)
    return out


def write_coco(document: DataFrame, path: str) -> None:
    """One folder per part, lines sorted by id within their files."""
    document.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
