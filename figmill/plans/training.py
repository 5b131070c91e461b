"""Queries of the general operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.operators import drift, shred, units
from figmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found(table(spark, d, "raw_packets"), table(spark, d, "packet_schema"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_packets"), table(spark, d, "packet_schema"))


def p1_profiles(spark: SparkSession, d: str) -> DataFrame:
    return drift.sketch_table(table(spark, d, "raw_packets"), table(spark, d, "packet_schema")).select("path", F.array_join("types", "|").alias("types"), "files", "objects")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(table(spark, d, "evidence_packets"), table(spark, d, "unit_codes"))


def p4_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.converted(table(spark, d, "evidence_packets"), table(spark, d, "unit_codes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.found(table(spark, d, "raw_packets"))


def p5_legend_items(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_legend_items(table(spark, d, "raw_packets"))


def p5_packets(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_packets(table(spark, d, "raw_packets"))


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_tables(table(spark, d, "raw_packets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_unified, p1_profiles, p4_found, p4_converted, p5_found, p5_legend_items, p5_packets, p5_tables)}
ORACLE_SQL: dict[str, str] = {}
