"""Knowledge of abbreviations and conditions: the prompt that asks for it, the reply, and its use.

The model itself is a seam; a reply is a text. Any failure gives empty maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from figmill.functions.values import clean_json
from figmill.operators.evidence import resolved

MAPS = "term_mapping map<string,string>, global_conditions map<string,string>"
TEXT_LIMIT = 100_000


def prompt(terms: Column, text: Column, limit: int = TEXT_LIMIT) -> Column:
    """The question for a document: its terms (an array) and the start of its text."""
    return F.concat(F.lit("Terms: "), F.array_join(F.array_sort(terms), ", "), F.lit("\nText: "), F.substring(F.coalesce(text, F.lit("")), 1, limit))


def replies(rows: DataFrame, key: str = "doc_id", reply: str = "reply") -> DataFrame:
    """key, term_mapping, global_conditions: replies parsed, with or without a code fence; empty maps where that fails."""
    parsed = F.from_json(clean_json(F.col(reply)), MAPS)
    empty = F.create_map().cast("map<string,string>")
    return rows.select(key, parsed.alias("k")).select(key, *(F.coalesce(F.col(f"k.{m}"), empty).alias(m) for m in ("term_mapping", "global_conditions")))


def explained(items: DataFrame, knowledge: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Items with their text followed by its meaning, by the mapping of their own document."""
    j = items.join(knowledge.select(key, "term_mapping"), key, "left")
    return j.withColumn(text, resolved(F.col(text), F.try_element_at("term_mapping", F.col(text)))).drop("term_mapping")


def with_conditions(points: DataFrame, knowledge: DataFrame, key: str = "doc_id") -> DataFrame:
    """Points with a column ``conditions`` (map) of their document; empty where nothing is known."""
    empty = F.create_map().cast("map<string,string>")
    return points.join(knowledge.select(key, F.col("global_conditions").alias("conditions")), key, "left").withColumn("conditions", F.coalesce("conditions", empty))
