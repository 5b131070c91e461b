"""Queries of the text operators, for the entry point to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.llm import lookalikes, packing, scan_noise, subjects, tokens
from figmill.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.found(table(spark, d, "documents"), table(spark, d, "evidence_packets"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(table(spark, d, "documents"), table(spark, d, "evidence_packets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(table(spark, d, "evidence_packets"), table(spark, d, "series_names"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_labels(table(spark, d, "evidence_packets"), table(spark, d, "series_names"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p6_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return tokens.lexicon(table(spark, d, "documents"), "byte_bpe_50k").select("word", "n", F.size("ids").alias("pieces"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p7_containers(spark, d))


def _subjects(f: Callable, spark: SparkSession, d: str) -> DataFrame:
    return f(*(table(spark, d, t) for t in ("documents", "doc_labels", "subject_areas")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.found, spark, d)


def p8_mixtures(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.mixtures, spark, d)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.composition, spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_repaired, p3_found, p3_canonical, p6_ids, p6_decoded, p6_lexicon, p7_containers, p7_summary, p8_found, p8_mixtures, p8_composition)
}
#: Every document's text comes back from its ids.
ORACLE_SQL: dict[str, str] = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
