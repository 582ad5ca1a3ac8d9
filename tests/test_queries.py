"""Every query that has SQL gives the rows of that SQL; the others give rows."""

import compare
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def database(medium):
    return compare.database(medium)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, medium, database, name):
    names, ours = compare.spark_rows(QUERIES[name](spark, medium))
    sql_names, theirs = compare.sql_rows(database, SQL[name])
    assert names == sql_names
    assert theirs, "the SQL should give rows"
    assert compare.differences(ours, theirs) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_a_row_per_column(spark):
    assert contract.entry(spark).count() == 11
