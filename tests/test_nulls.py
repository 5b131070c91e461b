"""Rows of nulls in every column, repeated rows and further columns, for the registered queries of the general operators."""

import pytest
from pyspark.sql import functions as F

from figmill.plans import catalog

TABLES = ["documents", "doc_labels", "evidence_packets", "raw_packets", "micro_detections", "table_cells", "packet_schema", "series_names", "unit_codes", "subject_areas", "container_specs"]
FIXED = {"packet_schema", "series_names", "unit_codes", "subject_areas", "container_specs"}
TYPES = {
    "p1_found": [("file_id", "bigint"), ("field_path", "string"), ("change", "string")],
    "p4_found": [("packet_id", "bigint"), ("axis", "string"), ("unit_code", "string"), ("scale_exp", "int")],
    "p5_found": [("file_id", "bigint"), ("figure_id", "string"), ("item_no", "int"), ("source_file", "string")],
}


def dirty(spark, data, folder):
    """The tables with rows of nulls, repeated rows and extra columns."""
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        if t not in FIXED:
            part = df.limit(40)
            nulls = spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema.__class__([type(f)(f.name, f.dataType, True) for f in df.schema]))
            df = part.unionByName(part.limit(5)).unionByName(nulls)
            for c in df.columns[1:]:  # one column null at a time
                df = df.unionByName(part.limit(1).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        for extra in ("n", "path", "word", "change", "version", "block", "cross", "bin"):
            if extra not in df.columns:
                df = df.withColumn(extra, F.lit("x"))
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")


@pytest.fixture(scope="module")
def dirty_data(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dirty"))
    dirty(spark, data, folder)
    return folder


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_survives_nulls(spark, dirty_data, name):
    catalog.queries()[name](spark, dirty_data).collect()


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(spark, data, name):
    assert catalog.queries()[name](spark, data).dtypes == TYPES[name]
