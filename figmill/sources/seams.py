"""Seams for models: a protocol for what a model adds to rows, and recorded outputs that stand in for it.

No model is part of this repository. An adapter opens its model once per task and
maps batches of rows; an error of one row becomes its ``error`` and doesn't end the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: What each seam reads and what it adds.
SEAMS = {
    "regions": ("page images", "page_no int, label string, score double, x1 double, y1 double, x2 double, y2 double"),
    "layout": ("figure images", "label string, conf double, x1 double, y1 double, x2 double, y2 double"),
    "detections": ("plot images", "label string, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double"),
    "components": ("table images", "label string, conf double, x1 double, y1 double, x2 double, y2 double"),
    "structure": ("table bodies", "kind string, ord int, score double, x1 double, y1 double, x2 double, y2 double"),
    "cell_class": ("cell images", "kind string"),
    "text": ("text crops", "text string, conf double"),
    "molecule": ("structure crops", "text string"),
    "knowledge": ("texts and terms", "term_mapping map<string,string>, global_conditions map<string,string>"),
    "table_reply": ("table images", "is_valid boolean, reason string, csv_content string"),
}


@dataclass
class Adapter:
    """A model as a function: ``open`` runs once per task and returns the function of one row's value."""

    open: Callable[[], Callable[[object], list[dict]]]
    schema: str

    def apply(self, rows: DataFrame, key: str, value: str) -> DataFrame:
        """key, the columns of the schema, and error: what the model says of each row."""
        opener, names = self.open, [c.split(" ")[0] for c in _fields(self.schema)]
        kind = dict(rows.dtypes)[key]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = opener()
            for pdf in it:
                out = []
                for k, v in zip(pdf[key], pdf[value]):
                    try:
                        out += [{**dict.fromkeys(names), **r, key: k, "error": None} for r in model(v)]
                    except Exception as e:  # noqa: BLE001 - one bad row must not end the job
                        out.append({**dict.fromkeys(names), key: k, "error": str(e)[:500]})
                yield pd.DataFrame(out, columns=[key, *names, "error"])

        return rows.select(key, value).mapInPandas(run, f"{key} {kind}, {self.schema}, error string")


def _fields(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def recorded(rows: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The default of every seam: outputs recorded by an earlier run, joined by the rows' key."""
    return outputs.join(rows.select(key).distinct(), key, "left_semi")
