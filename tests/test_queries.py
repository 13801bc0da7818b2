"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_comparison_can_fail(spark, con, monkeypatch):
    broken = {**entry.oracle_sql(), "sector_lags": entry.oracle_sql()["sector_lags"].replace("LAG(amount, 2)", "LAG(amount, 3)")}
    monkeypatch.setattr(entry, "oracle_sql", lambda: broken)
    assert "differ" in compare(spark, con, SF, "sector_lags")
