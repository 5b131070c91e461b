import pytest

from figmill.llm.queries import QUERIES
from tests.test_nulls import dirty

TYPES = {
    "p2_found": [("origin", "string"), ("row_id", "bigint"), ("field", "string"), ("item_no", "int"), ("defect", "string")],
    "p3_found": [("packet_id", "bigint"), ("field", "string"), ("item_no", "int"), ("name_id", "int")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint"), ("subject_id", "int")],
}


@pytest.fixture(scope="module")
def dirty_data(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dirty"))
    dirty(spark, data, folder)
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_survives_nulls(spark, dirty_data, name):
    QUERIES[name](spark, dirty_data).collect()


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(spark, data, name):
    assert QUERIES[name](spark, data).dtypes == TYPES[name]
