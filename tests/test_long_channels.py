"""Channels that no task holds as a whole: scans, filters, spectra and decompositions by blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import blocks, filters, interpolate, signals, structures
from tideline.sources import synthetic


def walk(spark, n, channels=2, gap=None):
    """A rough signal that depends on channel and number only."""
    rows = spark.range(n).select(F.col("id").alias("sample_ix")).withColumn("ch_ix", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    value = F.pmod(F.xxhash64("ch_ix", "sample_ix"), F.lit(2001)) / 100.0 - 10
    out = rows.select(F.lit(1).cast("long").alias("shot"), "ch_ix", "sample_ix", (F.col("sample_ix") * 0.5).alias("t"), value.alias("value"))
    return out.where(~F.col("sample_ix").between(*gap)) if gap else out


def columns(df, *names):
    rows = df.orderBy("ch_ix", "sample_ix").toPandas()
    return {c: [g[n].to_numpy() for n in names] for c, g in rows.groupby("ch_ix")}


@pytest.mark.parametrize("gap", [None, (100, 399)])
def test_running_sums_and_unwrapping_cross_blocks(spark, gap):
    smp = walk(spark, 1000, gap=gap)
    for _, (x, got) in columns(signals.running_sum(smp, size=64), "value", "running").items():
        assert np.allclose(got, np.cumsum(x))
    plain = columns(smp, "value")
    for c, (got,) in columns(signals.unwrap(smp, size=64), "value").items():
        assert np.allclose(got, np.unwrap(plain[c][0]), atol=1e-9)


def test_evenness_is_seen_across_blocks(spark):
    smp = walk(spark, 300)
    assert {r["contiguous"] for r in signals.contiguity(smp).collect()} == {True}
    shifted = smp.withColumn("t", F.col("t") + F.when((F.col("ch_ix") == 1) & (F.col("sample_ix") >= 128), 1.0).otherwise(0.0))
    assert {r["ch_ix"]: r["contiguous"] for r in signals.contiguity(shifted).collect()} == {0: True, 1: False}


def window_lines(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]


def test_no_window_over_a_channel(spark):
    smp = walk(spark, 1000)
    for out in (signals.subtract_mean(smp), signals.normalise(smp, "rms"), signals.segment(smp, 50, 2)):
        assert window_lines(out) == []
    for out in (signals.running_sum(smp, size=64), signals.unwrap(smp, size=64), interpolate.multichannel(smp), interpolate.nearest(smp, smp, "ch_ix", "t", "t")):
        lines = window_lines(out)
        assert lines and all("__block" in line.split("windowspecdefinition")[1] for line in lines)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_recurrence_in_lanes_is_the_plain_recursion(n):
    sections = filters.design(3, (0.07, 0.09))
    x = np.random.default_rng(0).normal(size=n)
    want, state = [], [[0.0, 0.0] for _ in sections]
    for v in x.tolist():
        for s, (b0, b1, b2, a1, a2) in zip(state, sections, strict=True):
            o = b0 * v + s[0]
            s[0], s[1] = b1 * v - a1 * o + s[1], b2 * v - a2 * o
            v = o
        want.append(v)
    got, last = filters.run_sections(x, sections)
    assert np.allclose(got, want, atol=1e-9) and np.allclose(last, np.ravel(state), atol=1e-9)
    half, middle = filters.run_sections(x[: n // 3], sections)
    rest, end = filters.run_sections(x[n // 3 :], sections, middle)
    assert np.allclose(np.concatenate((half, rest)), want, atol=1e-9) and np.allclose(end, last, atol=1e-9)


@pytest.mark.parametrize("size", [100, 4096])
def test_band_pass_by_blocks(spark, size):
    smp = walk(spark, 3000)
    order, band = filters.least_order((0.35, 0.45), (0.25, 0.55), 1.0, 10.0)
    sections = filters.design(order, band)
    plain = columns(smp, "value")
    for c, (i, t, got) in columns(filters.bandpass(smp, (35e3, 45e3), (25e3, 55e3), 1.0, 10.0, 2e5, size=size), "sample_ix", "t", "value").items():
        assert np.allclose(got, filters.run_sections(plain[c][0], sections)[0], atol=1e-9)
        assert (i == np.arange(3000)).all() and np.allclose(t, i * 0.5)


def test_neighbours_over_ranges_without_known_values(spark):
    """Long stretches of wanted places between two samples; equal times; a shot without samples on one side."""
    known = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 0, 1000.0, 25.0), (1, 0, 1000.0, 35.0), (2, 0, 500.0, 7.0)], "shot long, ch_ix int, t double, value double")
    grid = spark.range(-10, 1011).select(F.explode(F.expr("array(1L, 2L)")).alias("shot"), F.col("id").cast("double").alias("t"))
    got = {(r["shot"], r["t"]): r["value"] for r in interpolate.change_time_base(known, grid).collect()}
    assert len(got) == 2 * 1021
    for (shot, t), v in got.items():
        assert v == pytest.approx(7.0 if shot == 2 else np.interp(t, [0, 1000], [5, 30]))


def test_dense_places(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("x"), (F.col("id") % 3).alias("k"))
    got = blocks.numbered(rows, "x").toPandas().sort_values("place")
    assert (got["place"].to_numpy() == np.arange(5000)).all() and (np.diff(got["x"]) >= 0).all()
    for _, g in blocks.numbered(rows, "x", keys=("k",)).toPandas().groupby("k"):
        g = g.sort_values("place")
        assert (g["place"].to_numpy() == np.arange(len(g))).all() and (np.diff(g["x"]) >= 0).all()
    assert blocks.numbered(rows.where("false"), "x").count() == 0


def test_inverse_transforms_of_all_lags_grow_with_the_blocks(spark):
    smp = synthetic.multimode(spark, synthetic.MODES[:1], channels=2, n=2000, noise=0.2)
    x = {r["ch_ix"]: np.array(r["v"]) for r in smp.groupBy("ch_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_ix", "value"))), lambda z: z["value"]).alias("v")).collect()}
    want = np.correlate(x[0], x[1], "full")
    got = signals.correlate(smp, 0, 1, "full", block=100).orderBy("lag").toPandas()
    assert (got["lag"].to_numpy() == np.arange(-1999, 2000)).all() and np.allclose(got["correlation"], want, atol=1e-8)


def wide(smp):
    return smp.toPandas().pivot(index="ch_ix", columns="sample_ix", values="value").to_numpy()


@pytest.mark.parametrize(("size", "fan"), [(64, 3), (1000, 64)])
def test_tree_of_reductions_is_the_decomposition(spark, size, fan):
    smp = synthetic.multimode(spark, synthetic.MODES, channels=6, n=1500, noise=0.3)
    x = wide(smp)
    _, want, _ = np.linalg.svd(x, full_matrices=False)
    found = structures.long_svd(smp, size, fan)
    r = found.first()
    assert np.allclose(r["svs"], want, rtol=1e-9) and r["energy"] == pytest.approx((x**2).sum()) and r["error"] is None
    z = structures.chronos(smp, found, size).toPandas().pivot(index="number", columns="sample_ix", values="chrono").to_numpy()
    assert np.allclose((np.array(r["topos"]).T * want) @ z, x)


def test_long_decompositions_tell_what_is_wrong(spark):
    smp = synthetic.multimode(spark, synthetic.MODES[:1], channels=3, n=300).withColumn("shot", F.explode(F.expr("array(1L, 2L, 3L)")))
    bad = smp.where("not (shot = 2 and ch_ix = 1 and sample_ix = 150)").withColumn("value", F.when(F.expr("shot = 3 and sample_ix = 7"), float("nan")).otherwise(F.col("value")))
    found = structures.long_svd(bad, 100, 2)
    assert {r["shot"]: r["error"] for r in found.collect()} == {1: None, 2: "samples are missing or repeated", 3: "values are missing or not finite"}
    assert {r["shot"] for r in structures.chronos(bad, found, 100).select("shot").distinct().collect()} == {1}
    assert structures.long_svd(bad.where("false")).count() == 0


def test_gram_sums_over_blocks(spark):
    smp = synthetic.multimode(spark, synthetic.MODES[:2], channels=4, n=700, noise=0.3).where("not (ch_ix = 1 and sample_ix > 300) and not (ch_ix = 3 and sample_ix < 400)")
    x = smp.toPandas().pivot(index="ch_ix", columns="sample_ix", values="value").fillna(0).to_numpy()
    got = {(r["ch_a"], r["ch_b"]): r["product"] for r in structures.gram(smp, 100).collect()}
    assert got.keys() == {(a, b) for a in range(4) for b in range(a, 4)} - {(1, 3)}
    assert all(v == pytest.approx((x @ x.T)[k]) for k, v in got.items())


def test_a_failed_shot_is_accounted_for(spark):
    from tideline.plans import mine

    rows = spark.range(60).select(F.col("id").alias("instance_id"), (F.col("id") % 3).alias("shot"), F.array(F.sin("id"), F.cos("id")).alias("phases"))
    bad = rows.withColumn("phases", F.when(F.col("instance_id") == 4, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("phases")))
    found = mine.shot_clusters(bad, mine.Settings(n_clusters=2, n_iterations=3))
    assert [tuple(r) for r in mine.failures(found).collect()] == [(1, "ValueError: phases are missing or not finite")]
    assert found.where("error IS NULL").count() == 40


def test_one_large_group_has_its_exact_centroid(spark):
    from tideline.operators import statistics

    rng = np.random.default_rng(0)
    x = np.concatenate((rng.vonmises(3.0, 0.8, 2000), rng.vonmises(-1.0, 4.0, 30)))
    df = spark.createDataFrame([(0 if i < 2000 else 1, float(v)) for i, v in enumerate(x)], "cluster int, phase double")
    for r in statistics.exact_periodic_centroid(df, "cluster").collect():
        own = x[:2000] if r["cluster"] == 0 else x[2000:]
        grid = np.linspace(0, 2 * np.pi, 4001)
        cost = [((np.minimum(np.abs((own - c) % (2 * np.pi)), 2 * np.pi - (own - c) % (2 * np.pi))) ** 2).sum() for c in grid]
        assert r["q"] <= min(cost) + 1e-6 and r["q"] == pytest.approx(min(cost), rel=1e-4)
