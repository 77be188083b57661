"""Registered queries of the operators that SQL can express, against DuckDB."""

import pytest

from blobtide.llm.queries import ORACLE_SQL, QUERIES
from verification.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE_SQL[name])
