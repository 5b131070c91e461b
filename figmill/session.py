"""Session helpers shared by entry points, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("figmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a local one of our own only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or os.path.join(os.environ.get("TMPDIR", "/tmp"), "figmill-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a later
    pass reads rows back instead of computing them again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def looked_up(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", limit: int = 200_000) -> DataFrame:
    """Rows joined with a table that has one row per key. Up to ``limit`` rows the table is broadcast, so a key that many
    rows share is not gathered; beyond, both sides are shuffled. The result is the same either way. The table is cut, for
    its rows are counted first."""
    table = cut(table)
    return rows.join(F.broadcast(table) if table.limit(limit + 1).count() <= limit else table, on, how)
