"""Recorder files and archives as data sources."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.sources import readers


@pytest.fixture()
def folder(spark, tmp_path):
    readers.register(spark)
    rows = spark.range(6000).select(F.lit("SX8O").alias("diag"), (F.col("id") % 3 + 50_000).alias("shot"), (F.col("id") % 2 + 36).alias("channel"), F.floor(F.col("id") / 6).alias("sample_ix"), (F.col("id") % 200 - 100).cast("double").alias("value"))
    rows.repartition("shot", "channel").sortWithinPartitions("shot", "channel", "sample_ix").write.format("recorder").option("rate", 1000).mode("append").save(str(tmp_path))
    return tmp_path, rows


def test_what_is_written_is_read(spark, folder):
    path, rows = folder
    got = spark.read.format("recorder").load(str(path))
    assert got.rdd.getNumPartitions() == 6
    assert got.select(*rows.columns).exceptAll(rows).isEmpty() and rows.exceptAll(got.select(*rows.columns)).isEmpty()
    assert got.where("abs(t - sample_ix / 1000) > 1e-12").isEmpty()


def test_predicates_leave_files_out(spark, folder):
    path, _ = folder
    (path / "SX8O-49999-1-36.prm").write_text("broken")
    got = spark.read.format("recorder").option("gain", 2.0).load(str(path)).where("shot >= 50001 AND channel = 37 AND value > 0")
    assert got.rdd.getNumPartitions() == 2 and {r["shot"] for r in got.select("shot").distinct().collect()} == {50001, 50002}


def test_channels_are_found_where_they_stood(spark, folder):
    path, _ = folder
    assert readers.stored_as("FMD", 3, 50_000) == ("SX8O", 36) and readers.stored_as("FMD", 3, 26_000) == ("SX8O", 37)
    assert readers.stored_as("FMD", 0, 50_000) == ("SX8O", 0) and readers.stored_as("FMD", 3, 80_000) == ("FMD", 3) and readers.stored_as("XY", 3, 1) == ("XY", 3)
    got = readers.fetch(spark, str(path), [50_000, 50_002], "FMD", 3)
    assert {(r["shot"], r["diag"], r["ch_ix"], r["n"]) for r in got.groupBy("shot", "diag", "ch_ix").agg(F.count(F.lit(1)).alias("n")).collect()} == {(50_000, "FMD", 3, 1000), (50_002, "FMD", 3, 1000)}


def test_archives(spark, tmp_path):
    readers.register(spark)
    np.savez(tmp_path / "12_MP5.npz", signal=np.array([1, -2], "i2"), timebase=np.array([0.0, 0.5]))
    got = spark.read.format("signal_archive").load(f"file://{tmp_path}")
    assert [tuple(r) for r in got.orderBy("sample_ix").collect()] == [(12, "MP5", 0, 0.0, 1.0), (12, "MP5", 1, 0.5, -2.0)]
    np.savez(tmp_path / "13_x.npz", signalexpr="signal = 1")
    with pytest.raises(Exception, match="no signal"):
        spark.read.format("signal_archive").load(str(tmp_path)).collect()


def test_written_tables_can_be_discarded(spark):
    from tideline.sources import files

    begin = len(files.MADE)
    kept = files.written(spark.range(4))
    assert kept.count() == 4
    files.discard(spark, begin)
    assert len(files.MADE) == begin
    with pytest.raises(Exception, match="(?i)not exist|not found|FAILED_READ_FILE"):
        kept.collect()
