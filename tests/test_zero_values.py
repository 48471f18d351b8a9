"""Queries over events whose value is 0, beside their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.compare import same
from tideline.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Of the first of two types one value is 0."""
    folder = tmp_path_factory.mktemp("zeros")
    rows = [(1, "click", 0.0), (2, "click", 3.5), (3, "view", 12.0), (4, "view", 0.01), (5, "click", 400.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def con(zeros):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet/*.parquet'")
    return con


def agrees(name, spark, zeros, con):
    got = QUERIES[name](spark, zeros)
    assert same(got.toPandas(), con.execute(ORACLES[name]).df()) == ""
    return {r[0]: r for r in got.collect()}


def test_convert_kappa_std_at_0(spark, zeros, con):
    assert agrees("convert_kappa_std", spark, zeros, con)[1]["std"] == float("inf")


def test_gamma_fit_of_values_with_a_0(spark, zeros, con):
    """No gamma distribution has a value of 0; the other type is fitted."""
    got = agrees("gamma_fit", spark, zeros, con)
    assert math.isnan(got["click"]["shape"]) and math.isnan(got["click"]["theta"])
    assert got["view"]["shape"] > 0


def test_normal_pdf_at_0(spark, zeros, con):
    got = agrees("normal_pdf", spark, zeros, con)[1]
    assert (got["x"], got["density"]) == (float("-inf"), 0.0)
