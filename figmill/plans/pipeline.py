"""The whole way from recorded outputs to files, for all papers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.operators import detect, drift, evidence, pixels, points, series, tables
from figmill.operators.detect import FIGURE
from figmill.operators.knowledge import replies
from figmill.session import cut, table
from figmill.sources import files


def run(spark: SparkSession, folder: str, out: str, texts: DataFrame, colours: DataFrame, pixels_: DataFrame | None = None, knowledge: DataFrame | None = None) -> DataFrame:
    """Write points, pixel fallbacks, packets in one schema, wide points by figure, table grids and a manifest below ``out``; returns the manifest.

    ``texts`` (det_id, text) and ``colours`` (det_id, h, s, v) are the recorded outputs of recognition, ``pixels_`` (figure,
    grey) tells heatmaps, ``knowledge`` (paper_id, reply) holds a model's replies on terms and conditions."""
    dets = points.cleaned(detect.detections(table(spark, folder, "micro_detections")))
    named = series.marker_texts(dets).join(texts.select(F.col("det_id").alias("text_id"), F.col("text").alias("series")), "text_id")
    protos = series.prototypes(named.join(colours.withColumnRenamed("det_id", "marker_id"), "marker_id"))
    data = dets.where("label = 'data_point'")
    modes = None if pixels_ is None else pixels.heatmaps(pixels_, FIGURE).select(*FIGURE, "heatmap", F.lit(False).alias("log_x"))
    mapped = cut(points.mapped(dets, texts, series.nearest_series(data.join(colours, "det_id"), protos), modes))
    files.write_parquet(mapped, f"{out}/points", ["paper_id"])
    files.write_parquet(points.pixel_fallback(dets, mapped), f"{out}/pixels", ["paper_id"])
    own = table(spark, folder, "evidence_packets")
    known = spark.createDataFrame([], "paper_id string, reply string") if knowledge is None else knowledge
    files.write_fused(evidence.fused_wide(own, replies(known, "paper_id")), f"{out}/fused")
    packets = drift.unified(table(spark, folder, "raw_packets"), table(spark, folder, "packet_schema"))
    files.write_packets(packets, f"{out}/packets")
    files.write_parquet(evidence.points(table(spark, folder, "evidence_packets")), f"{out}/packet_points")
    cells = tables.placed(tables.flat_cells(table(spark, folder, "table_cells")))
    files.write_csv(tables.pivoted(cells), f"{out}/grids", header=False, by=["paper_id", "table_id"])
    manifest = dets.groupBy(*FIGURE).agg(F.count_if(F.col("label") == "data_point").alias("detected")).join(mapped.groupBy(*FIGURE).agg(F.count(F.lit(1)).alias("points")), FIGURE, "left").withColumn("written", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return manifest
