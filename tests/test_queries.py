"""Every query outside the text subpackage against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import connect, same

CORE = {n: f for m in entry._modules() if ".llm" not in m.__name__ for n, f in m.QUERIES.items()}
SQL = {n: s for m in entry._modules() if ".llm" not in m.__name__ for n, s in getattr(m, "ORACLE_SQL", {}).items()}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    same(CORE[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_gives_figures(spark, small, name):
    rows = CORE[name](spark, small).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
