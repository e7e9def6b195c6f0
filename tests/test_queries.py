import os

import pytest

import __spark_entry__
from lodestone.plans import queries
from oracle import assert_same

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
