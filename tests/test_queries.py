"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import differences, sql_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return sql_tables(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, tables, name):
    problem, _ = differences(spark, tables, name, SF_DIR)
    assert not problem


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["user_id", "sample_id", "n_messages", "risk"]
    assert result.count() == 50


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
