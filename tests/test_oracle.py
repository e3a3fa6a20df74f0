"""Every core query against its SQL, and queries without SQL for rows and a stable schema."""

import pytest
from compare import compare, connect
from conftest import ORACLE, SMALL

from codeloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(ORACLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, ORACLE, name) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_has_rows(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0
