import pytest

from figmill.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

COLUMNS = {
    "p2_found": ["origin", "row_id", "field", "item_no", "defect"], "p3_found": ["packet_id", "field", "item_no", "name_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "subject_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in ORACLE_SQL:
        assert oracle.rows_of(df) == oracle.rows_of_sql(oracle.connect(data), ORACLE_SQL[name])
    else:
        df.collect()
