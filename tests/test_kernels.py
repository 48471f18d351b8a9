"""Numeric kernels against NumPy fixtures, planted modes and planted mixtures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import cluster, features, filters, signals, spectral, statistics, structures
from tideline.plans.mine import Settings, mine, restore, save
from tideline.sources import synthetic

TWO = synthetic.MODES[:2]


def wide(df):
    return df.toPandas().pivot(index="ch_ix", columns="sample_ix", values="value").to_numpy()


def test_segments_leave_the_last_exact_one_out(spark):
    ramp = synthetic.ramp(spark)
    assert signals.segment(ramp, 10).select("seg_ix").distinct().count() == 9
    assert signals.segment(ramp, 10, include_last=True).select("seg_ix").distinct().count() == 10
    assert signals.segment(ramp, 10, 2).groupBy("seg_ix").count().where("count <> 10").count() == 0


def test_svd_rebuilds_its_input(spark):
    smp = synthetic.multimode(spark, TWO, noise=0.5).withColumn("seg_ix", F.lit(0).cast("long"))
    r = structures.svd(smp).first()
    built = (np.array(r["topos"]).T * np.array(r["svs"])) @ np.array(r["chronos"])
    x = wide(smp)
    assert np.allclose(built, x)
    assert r["energy"] == pytest.approx((x**2).sum())
    assert sum(r["p"]) == pytest.approx(1) and 0 < r["entropy"] < 1


def test_structures_find_the_planted_modes(spark):
    smp = synthetic.multimode(spark, TWO, noise=0.01).withColumn("seg_ix", F.lit(0).cast("long"))
    found = {tuple(r["svs"]): r for r in structures.structures(smp).collect()}
    first, second = found[(0, 1)], found[(2, 3)]
    assert first["freq"] == pytest.approx(24e3, abs=1e3) and second["freq"] == pytest.approx(37e3, abs=1e3)
    assert first["p"] == pytest.approx(0.49 / 0.74, abs=0.02) and second["p"] == pytest.approx(0.25 / 0.74, abs=0.02)
    assert first["dphase"] == pytest.approx([2 * math.pi * 3 / 10] * 9, abs=0.05)
    assert first["svs_mask"] == 3 and 0.9 < first["a12"] <= 1
    assert structures.valid_structures(structures.structures(smp), 0.05, 2).count() == 2


def test_grouping_is_by_largest_drop_or_threshold():
    gamma = np.array([[1, 0.9, 0.1, 0.05], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.7], [0.05, 0.1, 0.7, 1]])
    p = np.array([0.5, 0.3, 0.15, 0.05])
    assert structures.group_geometric(gamma, p) == [[0, 1], [2], [3]] or structures.group_geometric(gamma, p)[0] == [0, 1]
    assert structures.group_threshold(gamma, p) == [[0, 1], [2, 3]]
    assert structures.group_geometric(gamma, p, max_energy=0.85) in ([[0], [1]], [[0, 1]])


def test_a_bad_segment_stops_no_other(spark):
    smp = synthetic.multimode(spark, TWO, n=64).withColumn("seg_ix", F.when(F.col("sample_ix") < 32, 0).otherwise(1).cast("long"))
    bad = smp.withColumn("value", F.when(F.col("seg_ix") == 1, float("nan")).otherwise(F.col("value")))
    errors = {r["seg_ix"]: r["error"] for r in structures.svd(bad).collect()}
    assert errors[0] is None and errors[1]


@pytest.mark.parametrize("size", [32, 16_384])
def test_fft_equals_direct_transform(spark, size):
    smp = synthetic.multimode(spark, TWO, channels=2, n=200, noise=0.3)
    x = wide(smp)
    got = spectral.stft(smp, 32, 8, size=size).orderBy("ch_ix", "win_ix", "f_ix").toPandas()
    assert len(got) == 2 * 21 * 17
    k = np.arange(32)
    for (c, w, f), r in got.set_index(["ch_ix", "win_ix", "f_ix"]).iterrows():
        z = (x[c, 8 * w : 8 * w + 32] * (0.54 - 0.46 * np.cos(2 * np.pi * k / 31)) * np.exp(-2j * np.pi * f * k / 32)).sum() / 32
        assert (r["re"], r["im"]) == pytest.approx((z.real, z.imag), abs=1e-9)
        assert r["t"] == pytest.approx((8 * w + 15.5) * 1e-6) and r["f"] == pytest.approx(f / 32e-6, abs=1e-3)


def test_missing_samples_count_as_zero(spark):
    smp = synthetic.multimode(spark, TWO, channels=1, n=200)
    gap = smp.where("sample_ix NOT BETWEEN 70 AND 101")
    got = spectral.stft(gap, 16, 8, size=32).toPandas().set_index(["win_ix", "f_ix"])
    zero = spectral.stft(smp.withColumn("value", F.when(F.col("sample_ix").between(70, 101), 0.0).otherwise(F.col("value"))), 16, 8).toPandas().set_index(["win_ix", "f_ix"])
    assert {w for w, _ in got.index} == {w for w in range(19) if w not in (9, 10)}  # 168 samples; two windows are empty
    assert np.allclose(got["re"], zero.loc[got.index, "re"], atol=1e-9) and np.allclose(got["im"], zero.loc[got.index, "im"], atol=1e-9)


def test_peak_frequency_of_one_mode(spark):
    smp = synthetic.multimode(spark, synthetic.MODES[2:3], channels=1, n=10_001, noise=0.2)
    got = spectral.peak_freq(spectral.stft(smp, 10_000, 10_000)).first()
    assert got["freq"] == pytest.approx(27e3, abs=100)


def test_butterworth_keeps_its_band(spark):
    modes = (synthetic.Mode(10.0, 20e3, 3, 0.2), synthetic.Mode(2.0, 40e3, 4, 0.3), synthetic.Mode(10.0, 60e3, 5, 0.4))
    smp = synthetic.multimode(spark, modes, channels=3, n=1024).drop("diag")
    out = wide(filters.bandpass(smp, (35e3, 45e3), (25e3, 55e3), 1.0, 10.0, 1e6))[:, 400:]
    z = np.abs(np.fft.rfft(out * np.hanning(out.shape[1]), axis=1))
    f = np.fft.rfftfreq(out.shape[1], 1e-6)
    assert (np.abs(f[z.argmax(axis=1)] - 40e3) < 2.5e3).all()


def test_butterworth_response():
    order, band = filters.least_order((0.07, 0.09), (0.05, 0.11), 1.0, 10.0)
    z = np.exp(1j * np.pi * np.array([0.05, 0.07, 0.0793, 0.09, 0.11]))
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in filters.design(order, band)], axis=0)
    db = 20 * np.log10(np.abs(h))
    assert db[0] <= -10 and db[4] <= -10 and db[1] >= -1.01 and db[3] >= -1.01 and db[2] == pytest.approx(0, abs=0.1)


def test_signals_leave_a_history_and_their_input(spark):
    s = signals.Signals(synthetic.ramp(spark, 2))
    out = s.reduce_time(-0.25, 0.25).subtract_mean().normalise("var")
    assert [h[0] for h in out.history] == ["reduce_time", "subtract_mean", "normalise"] and s.history == ()
    assert out.samples.count() == 100 and s.samples.count() == 200
    with pytest.raises(AttributeError):
        s.nothing()


def planted(spark, n=1500, k=3, d=4, **options):
    return cluster.artificial(spark, n, k, d, seed=4, kappas=(8.0, 20.0), **options).cache()


def score(rows, found):
    pairs = statistics.similarity(rows.withColumnRenamed("truth", "cluster"), found.assignments)
    return statistics.accuracy(pairs).first()["accuracy"]


@pytest.mark.parametrize("method", ["EM_VMM", "k_means", "k_means_periodic"])
def test_planted_mixtures_are_recovered(spark, method):
    rows = planted(spark)
    options = {"seeds": tuple(range(8)), "tolerance": 1.0} if method == "k_means_periodic" else {}
    assert score(rows, cluster.cluster(rows, method, n_clusters=3, **options)) >= 0.95


def test_mixture_likelihood_grows(spark):
    rows = planted(spark)
    trace = cluster.EM_VMM(rows, n_clusters=3, n_iterations=6, start="random").details["trace"]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(trace, trace[1:], strict=False))


def test_gaussian_and_joint_mixtures(spark):
    rows = planted(spark).withColumn("values", F.array(F.col("truth") * 2.0 + F.get("phases", F.lit(0)) * 0.01, F.col("truth") * -1.0 + F.get("phases", F.lit(1)) * 0.01))
    assert score(rows, cluster.cluster(rows, "EM_GMM", n_clusters=3, n_starts=3)) >= 0.95
    assert score(rows, cluster.cluster(rows, "EM_VMM_GMM", n_clusters=3, n_starts=2)) >= 0.95


def test_hard_assignments_and_unknown_methods(spark):
    rows = planted(spark)
    found = cluster.EM_VMM(rows, n_clusters=3, hard=True)
    assert found.assignments.agg(F.min("probability")).first()[0] == 1.0
    with pytest.raises(ValueError):
        cluster.cluster(rows, "nothing")


def test_full_covariance_mixture(spark):
    rows = planted(spark, kind="covariant")
    assigned, _ = cluster.full_gmm(rows, 3, "phases")
    assert assigned.count() == 1500
    found = cluster.cluster(rows, "EM_GMM", n_clusters=3, column="phases", covariance_type="full", sin_cos=True)
    assert found.assignments.count() == 1500 and found.details["covariances"].shape == (3, 8, 8)
    assert found.details["bic"] > -2 * found.details["ll"]


@pytest.mark.parametrize("method", ["k_means", "k_means_periodic", "EM_VMM"])
def test_empty_tables_have_an_empty_clustering(spark, method):
    found = cluster.cluster(planted(spark).limit(0), method)
    assert found.assignments.count() == 0 and found.parameters == []


def test_artificial_weights_must_add_up(spark):
    with pytest.raises(ValueError):
        cluster.artificial(spark, 10, 2, 2, weights=(0.5, 0.6))
    shares = statistics.shares(cluster.artificial(spark, 4000, 2, 2, weights=(0.8, 0.2)).withColumnRenamed("truth", "cluster")).collect()
    assert max(r["share"] for r in shares) == pytest.approx(0.8, abs=0.05)


def test_kappa_lookup_is_near_the_truth():
    rng = np.random.default_rng(0)
    for kappa in (1.0, 5.0, 30.0):
        r = abs(np.exp(1j * rng.vonmises(0.3, kappa, 20_000)).mean())
        assert cluster.kappa_unbiased(np.array([r]), 20_000)[0] == pytest.approx(kappa, rel=0.06)
        assert cluster.kappa_of(np.array([r]))[0] == pytest.approx(kappa, rel=0.1)


def test_batch_flow_and_its_saved_result(spark, tmp_path):
    smp = synthetic.multimode(spark, TWO, n=4096, noise=0.1)
    for shot in (1, 2):
        smp = smp.unionByName(synthetic.multimode(spark, TWO, n=4096, noise=0.1, seed=shot, shot=shot))
    rows, found = mine(smp, Settings(n_clusters=3, n_iterations=5, freq_range="10000-60000", n_peaks=4, nfft=512, step=128))
    assert rows.select("shot").distinct().count() == 3 and found.assignments.count() == rows.count()
    save(str(tmp_path / "saved"), rows, found)
    again = restore(spark, str(tmp_path / "saved"))
    assert again[0].count() == rows.count() and again[3]["method"] == "EM_VMM"


def test_settings_text_round_trip():
    s = Settings.from_text("shots: 1,2\nn_cl: 4\nmethod: k_means\nbad line\ncutoff: 3")
    assert (s.shots, s.n_clusters, s.method, s.cutoff_value) == ("1,2", 4, "k_means", 80.0)
    assert Settings.from_text(s.text()) == s


def test_structure_features_with_other_signals(spark):
    smp = synthetic.multimode(spark, TWO, channels=4, n=4096, noise=0.05)
    rows = features.by_structures(smp, 1024, other=signals.get_channel(smp, 0)).collect()
    assert rows and all(len(r["phases"]) == 3 and len(r["other"]) == 1 for r in rows)


def test_a_tiny_far_cluster_is_found(spark):
    """Four rows of 40,000 lie apart; the first centres come from all rows."""
    x = spark.range(40_000).select(F.col("id").alias("instance_id"), F.when(F.col("id") % 10_000 == 7, F.array(F.lit(50.0), F.lit(-50.0))).otherwise(F.array(F.sin("id") + 3 * (F.col("id") % 3), F.cos("id"))).alias("values"))
    far, weight = cluster.far_candidates(x, "values", 4, 1)
    assert len(far) <= 1 + 3 * 16 and weight.sum() == 40_000
    found = cluster.cluster(x, "k_means", n_clusters=4, column="values", sin_cos=False)
    sizes = {r["cluster"]: r["count"] for r in found.assignments.groupBy("cluster").count().collect()}
    assert min(sizes.values()) == 4
