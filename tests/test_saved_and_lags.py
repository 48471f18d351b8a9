"""Saved analyses, archives, all lags by blocks, and the parts of a decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import reports, signals, structures
from tideline.operators.cluster import Clustering
from tideline.plans import mine
from tideline.sources import files, synthetic


def test_settings_from_result_and_list(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("instance_id"), F.lit(0).alias("cluster"))
    found = Clustering(rows, [{"cluster": 0, "dim": 0, "kind": "centre", "loc": 0.0, "scale": 1.0, "weight": 1.0}], {"method": "k_means", "n_clusters": 1})
    wanted = mine.Settings(shots="1-3", n_peaks=7)
    mine.save(f"{tmp_path}/one", rows.drop("cluster"), found, wanted)
    mine.save(f"{tmp_path}/two", rows.drop("cluster"), found)
    assert mine.settings_from_result(spark, f"{tmp_path}/one") == wanted
    with pytest.raises(LookupError):
        mine.settings_from_result(spark, f"{tmp_path}/two")
    got = {(r["saved"], r["name"]): r["value"] for r in files.list_clusterings(spark, str(tmp_path)).collect()}
    assert got[("one", "n_clusters")] == "1" and got[("two", "method")] == "k_means" and ("two", "analysis") not in got


def test_archive(spark, tmp_path):
    np.savez(tmp_path / "12_MP5.npz", signal=np.array([1, -2], "i2"), timebase=np.array([0.0, 0.5]))
    np.savez(tmp_path / "12_other.npz", signalexpr="signal = 1", timebaseexpr="timebase = 1", version=1, parent_element="x")
    got = files.archive(spark, str(tmp_path), 12, "MP5").orderBy("t").collect()
    assert [(r["shot"], r["t"], r["value"]) for r in got] == [(12, 0.0, -1.0), (12, 0.5, 2.0)]
    assert [r["value"] for r in files.archive(spark, str(tmp_path), 12, "A-MP5").orderBy("t").collect()] == [-1.0, 2.0]
    assert [r["value"] for r in files.archive(spark, str(tmp_path), 12, "-MP5").orderBy("t").collect()] == [1.0, -2.0]
    with pytest.raises(Exception, match="no signal"):
        files.archive(spark, str(tmp_path), 12, "other").collect()


@pytest.mark.parametrize("block", [4, 16_384])
def test_all_lags_by_blocks(spark, block):
    """Gaps, nulls, repeated samples and a shot without one channel, against plain sums of pairs."""
    rng = np.random.default_rng(3)
    rows = [(s, c, i, float(rng.normal())) for s in (1, 2) for c in (0, 1) for i in range(11) if (s, i) != (2, 5)]
    rows += [(1, 0, 3, 2.0), (1, 1, 40, 1.0), (1, 1, 41, None), (3, 0, 0, 1.0)]
    got = {(r["shot"], r["lag"]): r["correlation"] for r in signals.correlate(spark.createDataFrame(rows, "shot long, ch_ix int, sample_ix long, value double"), 0, 1, "full", block).collect()}
    want = {}
    for s, c, i, a in rows:
        for s2, c2, j, b in rows:
            if s == s2 and c == 0 and c2 == 1 and a is not None and b is not None:
                want[s, i - j] = want.get((s, i - j), 0.0) + a * b
    assert got == pytest.approx(want)


def test_parts_of_a_decomposition(spark):
    smp = synthetic.multimode(spark, synthetic.MODES[:1], n=512, noise=0.0)
    found = structures.svd(signals.segment(smp, 256))
    topos = reports.rep_svd_topos(found).groupBy("shot", "seg_ix", "number").agg(F.sum(F.col("topo") * F.col("topo")).alias("size")).where("number < 2").collect()
    assert topos and all(r["size"] == pytest.approx(1) for r in topos)
    spectra = reports.rep_svd_spectra(found, 1e-6).where("number = 0")
    assert spectra.groupBy("seg_ix").count().first()["count"] == 129
    assert reports.rep_svd_spectra(found, 1e-6, 100.0).agg(F.max("f_khz")).first()[0] <= 100


def test_first_structures(spark, sf):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "seg_ix int, fs_ix int")
    assert structures.first_structures(rows, 2).count() == 3


def test_empty_decomposition(spark, sf):
    rows = synthetic.sine(spark, n=10).where("false").withColumn("seg_ix", F.lit(0))
    found = structures.svd(rows)
    assert reports.rep_svd_topos(found).count() == 0 and reports.rep_svd_spectra(found, 1.0).count() == 0
