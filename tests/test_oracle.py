"""Every registered query against its SQL, and the contract functions."""

import pytest

import __spark_entry__ as contract
from checks import compare

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


# Queries without SQL have tests of their own (test_forecast): sparse changepoints and simulated bands.
WITHOUT_SQL = {"forecast_sparse", "forecast_simulated"}


def test_only_known_queries_are_without_sql():
    assert set(compare.QUERIES) - set(compare.ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("key", list(compare.ORACLE))
def test_query_equals_sql(spark, connection, key):
    assert compare.mismatch(spark, connection, SF, key) is None


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["entity_id", "n", "rmse"] and df.count() == 5


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_a_wrong_value_is_noticed(spark, connection, monkeypatch):
    monkeypatch.setitem(
        compare.ORACLE, "rmse_by_entity",
        compare.ORACLE["rmse_by_entity"].replace("count(*) AS n", "count(*) + 1 AS n"),
    )
    assert "rows differ" in compare.mismatch(spark, connection, SF, "rmse_by_entity")
