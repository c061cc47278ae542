"""Every registered query against its SQL text on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences, spark_table, sql_table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_table(QUERIES[name](spark, SF))
    if name in ORACLE:
        assert differences(got, sql_table(con, ORACLE[name])) == ""
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
