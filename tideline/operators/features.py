"""Feature extraction: from samples to phase features by structures or by spectral peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.angles import divide, phase_steps, zero_small
from tideline.operators import signals, spectral, structures
from tideline.operators.interpolate import change_time_base
from tideline.sources.files import written


def with_metadata(features: DataFrame, shots: DataFrame, *columns: str) -> DataFrame:
    """Metadata of each feature's shot; missing shots give nulls."""
    return features.join(shots.select("shot", *(columns or [c for c in shots.columns if c != "shot"])), "shot", "left")


def array_samples(samples: DataFrame, grid: DataFrame | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """An array's samples, put on another time base and cut to a time range if asked."""
    out = samples if grid is None else change_time_base(samples, grid)
    return out if start is None or end is None else signals.reduce_time(out, start, end)


def by_structures(samples: DataFrame, n: int = 1024, overlap: float = 1, power_cutoff: float = 0.05, min_svs: int = 2, low: float | None = None, high: float | None = None, other: DataFrame | None = None, spectra: DataFrame | None = None, **options) -> DataFrame:
    """Features of the coherent structures of each segment, with the values of other signals at the structure's time and its spectrum.

    The spectrum is the complex value of each channel in the cell of ``spectra`` nearest to the structure's time and frequency.

    instance_id is made of shot, segment and structure number, so that it needs no ordering.
    """
    found = structures.structures(signals.segment(samples, n, overlap), **options).where("error IS NULL")
    good = structures.valid_structures(found, power_cutoff, min_svs, low, high)
    out = good.select(
        F.xxhash64("shot", "seg_ix", "fs_ix").alias("instance_id"), "shot", "seg_ix", "fs_ix", "time", "freq", "a12", "p", "entropy", "energy", "svs_mask", "rms_scale", zero_small(F.col("dphase")).alias("phases"),
    )
    if other is not None:
        at = change_time_base(other, out.select("shot", F.col("time").alias("t")))
        rows = at.groupBy("shot", "t").agg(F.sort_array(F.collect_list(F.struct("ch_ix", "value"))).alias("z")).select("shot", F.col("t").alias("time"), F.transform("z", lambda z: z["value"]).alias("other"))
        out = out.join(rows, ["shot", "time"], "left")
    if spectra is not None:
        out = written(out)
        cells = spectral.spectrum_at(spectra, out.select(F.col("instance_id").alias("id"), "shot", "time", "freq"))
        out = out.join(cells.select(F.col("id").alias("instance_id"), F.col("amp").alias("spectrum")), "instance_id", "left")
    return out


def by_peaks(samples: DataFrame, nfft: int = 1024, step: int = 256, n_peaks: int = 20, low: float = 0.0, high: float = float("inf"), cutoff: float = 0.0) -> DataFrame:
    """Features of the spectral peaks: complex channel values and the wrapped phase steps between neighbours."""
    spectra = spectral.stft(samples, nfft, step)
    peaks = spectral.find_peaks(spectral.mean_power(spectra), n_peaks, low, high, cutoff)
    rows = spectral.gather(spectra, peaks)
    phases = phase_steps(F.transform("amp", lambda z: F.atan2(z["im"], z["re"])))
    return rows.select(F.xxhash64("shot", "win_ix", "f_ix").alias("instance_id"), "shot", "win_ix", "f_ix", "time", "freq", "amp", phases.alias("phases"))


def between_channels(features: DataFrame, how: str = "adjacent", channel: int = 0) -> DataFrame:
    """Complex ratios of channels: to the neighbour, to one channel, or to the sum or mean of all."""
    from tideline.functions import angles

    ways = {"adjacent": lambda a: angles.adjacent_ratio(a), "reference": lambda a: angles.reference_ratio(a, channel), "sum": angles.over_sum, "mean": angles.over_mean}
    return features.withColumn("ratio", ways[how](F.col("amp")))


def mean_mode_vector(features: DataFrame) -> DataFrame:
    """Mean complex vector of each cluster over its members, each divided by its first channel."""
    z = features.select("cluster", F.posexplode(F.transform("amp", lambda a: divide(a, F.get("amp", F.lit(0))))).alias("ch_ix", "z"))
    return z.groupBy("cluster", "ch_ix").agg(F.avg("z.re").alias("re"), F.avg("z.im").alias("im"), F.count(F.lit(1)).alias("n"))


def mode_pairs(vectors: DataFrame, places: DataFrame, most_n: int = 5, most_m: int = 8) -> DataFrame:
    """The pair of mode numbers (n, m) whose phases n phi + m theta at the probes (ch_ix, phi, theta) fit each cluster's mean vector best.

    A phase common to all probes is free: with the best one the mean squared distance of unit
    vectors is twice the misfit, 1 less the length of the mean of the turned vectors. Of pairs that
    fit alike the one of the smallest numbers is taken.
    """
    grid = F.explode(F.sequence(F.lit(-most_n), F.lit(most_n))).alias("n")
    rows = vectors.join(places, "ch_ix").select("cluster", F.atan2("im", "re").alias("a"), "phi", "theta", grid).withColumn("m", F.explode(F.sequence(F.lit(-most_m), F.lit(most_m))))
    off = F.col("a") - F.col("n") * F.col("phi") - F.col("m") * F.col("theta")
    length = F.sqrt(F.pow(F.sum(F.cos(off)), 2) + F.pow(F.sum(F.sin(off)), 2)) / F.count(F.lit(1))
    fits = rows.groupBy("cluster", "n", "m").agg((1 - length).alias("misfit"))
    best = F.min_by(F.struct("n", "m"), F.struct(F.round("misfit", 9), F.abs("n") + F.abs("m"), "n", "m"))
    return fits.groupBy("cluster").agg(best.alias("b"), F.min("misfit").alias("misfit")).select("cluster", "b.n", "b.m", "misfit")


def mode_numbers(vectors: DataFrame, angles: DataFrame, most: int = 10) -> DataFrame:
    """The whole mode number whose phase pattern over the channel angles (ch_ix, theta) fits each cluster's mean vector best.

    The fit is the length of the mean of z / |z| times the conjugate of the pattern.
    """
    n = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("mode")
    rows = vectors.join(angles, "ch_ix").select("cluster", F.atan2("im", "re").alias("a"), "theta", n)
    off = F.col("a") - F.col("mode") * F.col("theta")
    fits = rows.groupBy("cluster", "mode").agg((F.sqrt(F.pow(F.sum(F.cos(off)), 2) + F.pow(F.sum(F.sin(off)), 2)) / F.count(F.lit(1))).alias("fit"))
    return fits.groupBy("cluster").agg(F.max_by("mode", F.struct(F.round("fit", 9), -F.abs("mode"))).alias("mode"), F.max("fit").alias("fit"))
