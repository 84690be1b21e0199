"""Every text query runs on the smallest tables, with the columns that it must have."""

import pytest

from oracle import connect, same
from tidemark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p3_found": {"cand_id_a": "bigint", "cand_id_b": "bigint"},
    "p4_found": {"msg_id": "bigint", "defect": "string"},
    "p7_found": {"msg_id": "bigint"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "restored_chars": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])
