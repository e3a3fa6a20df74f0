"""The problems' queries: against SQL where there is some; schemas as stated."""

import pytest
from compare import compare, connect
from conftest import ORACLE, SMALL

from codeloom.llm import queries

SCHEMAS = {
    "p1_found": "src string, rec_key bigint", "p2_found": "pos int, group_key string", "p3_found": "term string, mark string", "p4_found": "src string, key_a bigint, key_b bigint",
    "p5_found": "src string, key_a bigint, key_b bigint", "p6_found": "src string, keep_key bigint, copy_key bigint", "p9_found": "doc_id bigint, start_off int, end_off int",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(ORACLE), ORACLE, name) == ""


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert df.count() > 0
    if name in SCHEMAS:
        assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == SCHEMAS[name]
