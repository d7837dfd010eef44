"""Every query with a DuckDB twin agrees with it; the rest return rows."""

import pytest
from conftest import FOLDER
from oracle_check import compare, connect

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_twin(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_rows(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
