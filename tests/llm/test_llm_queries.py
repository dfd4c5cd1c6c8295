"""Every query of the subpackage runs; those with SQL give the rows that SQL gives."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import sql_check  # noqa: E402

from folioscope.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(sql_check.DATA):
        pytest.skip("no test tables here")
    return sql_check.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    sql_check.compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, con, name):
    df = QUERIES[name](spark, sql_check.DATA)
    assert df.columns and df.count() > 0
