"""Every query with a SQL statement gives the same rows as that statement."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, SQL[name]) is None


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(queries())


def test_entry_gives_the_recorded_overview(spark):
    row = entry(spark).first()
    assert row["total_applications"] == 1500 and row["unique_customers"] == 150
    assert row["approved_or_disbursed"] == 603 and row["disbursed_loans"] == 429
    assert row["total_requested_amount"] == 374446791.61
    assert row["defaults_among_disbursed"] == 124
