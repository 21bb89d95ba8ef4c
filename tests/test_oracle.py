"""Every registered query against its DuckDB equivalent on the smallest tables."""

import functools
import os

import pytest

import __spark_entry__ as entry
import check_oracle
from tsengine.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return check_oracle.tables(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def shared_kpis():
    """The KPI row is the common input of many queries: build it once."""
    build = queries.kpi_rows
    queries.kpi_rows = functools.cache(build)
    yield
    queries.kpi_rows = build


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    assert check_oracle.difference(ours, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
