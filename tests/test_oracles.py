"""Every query of the signal engine runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from tests.compare import same, views
from tideline.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, con):
    assert same(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
