"""Every core query runs; those with SQL give the rows that SQL gives."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import sql_check  # noqa: E402

from folioscope.operators.numbering import numbered  # noqa: E402
from folioscope.plans import core_problems, reference_queries  # noqa: E402

QUERIES = {**core_problems.QUERIES, **reference_queries.QUERIES}
SQL = {**core_problems.SQL, **reference_queries.SQL}


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
    assert df.columns and df.count() >= 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x").repartition(7)
    assert [tuple(r) for r in numbered(df, ["x"], "n", 5).orderBy("x").collect()] == [(i, i + 5) for i in range(1000)]
    assert numbered(df.limit(0), ["x"], "n").count() == 0
