"""Raw packets as a stream: arriving files are shredded once, repeats within a watermark dropped.

The functions are those of the batch operators; a stream differs only in how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from figmill.operators import shred


def arriving(spark: SparkSession, folder: str, schema: str = "file_id long, paper_id string, file_name string, extractor string, produced_at timestamp, arrived_at timestamp, payload string") -> DataFrame:
    """Parquet files of raw packets as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def fresh(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Without files of the same name and content that arrive again within the delay; later rows than that are dropped."""
    return stream.withColumn("content", F.xxhash64("payload")).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["file_name", "content"]).drop("content")


def file_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """window, extractor, files: files per extractor and window of arrival."""
    return stream.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", window), "extractor").agg(F.count(F.lit(1)).alias("files"))


def shred_available(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Shred what has arrived into legend items under ``out`` and stop; run again for what comes later.

    Files that arrive again within the delay are dropped first. Each batch has a folder of its own that is written anew if the
    batch is repeated after a failure, so no item is there twice."""

    def step(batch: DataFrame, epoch: int) -> None:
        shred.flat_legend_items(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return fresh(stream, delay).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
