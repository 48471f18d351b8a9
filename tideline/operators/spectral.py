"""Short-time spectra, spectral peaks and what is gathered from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.angles import complex_struct
from tideline.functions.tapers import taper_array
from tideline.operators import blocks


def stft(samples: DataFrame, nfft: int, step: int, window: str = "hamming", size: int = 16_384, chunk: int = 1 << 19) -> DataFrame:
    """Short-time spectra of every channel by FFT.

    Samples are packed once into blocks of about ``size`` with a halo of one window, and a task takes
    one block at a time. Windows start every ``step`` samples below the channel's number of samples less ``nfft``. A
    missing sample counts as zero; a window without any gives nothing. The symmetric taper is applied, sums
    are divided by ``nfft``, a window's time is the mean of its times, and its own times give its
    frequencies, rounded to four places.
    """
    if nfft < 2:
        raise ValueError("a window has two samples at least")
    weights = taper_array(window, nfft)
    length = step * max(1, math.ceil(max(size, nfft) / step))
    kinds = dict(samples.dtypes)
    most = max(1, chunk // nfft)

    def spectra(at: np.ndarray, t: np.ndarray, x: np.ndarray, first: np.ndarray):
        """Number, mean time, sampling step and spectrum of the windows that begin at ``first``, counted from the block's start."""
        values, times = np.zeros(length + nfft), np.full(length + nfft, np.nan)
        values[at], times[at] = x, t
        for k in range(0, len(first), most):
            inside = first[k : k + most, None] + np.arange(nfft)
            some = np.isfinite(times[inside]).any(axis=1)
            inside = inside[some]
            own = times[inside]
            dt = (np.nanmax(own, axis=1) - np.nanmin(own, axis=1)) / (nfft - 1) if len(own) else np.zeros(0)
            yield first[k : k + most][some], np.nanmean(own, axis=1) if len(own) else np.zeros(0), dt, np.fft.rfft(values[inside] * weights / nfft, axis=1)

    def run(batches):
        for b in batches:
            for i, (block, n, *lists) in enumerate(zip(b["block"].to_pylist(), b["__n"].to_pylist(), *(blocks.arrays(b[c]) for c in ("sample_ix", "t", "value")), strict=True)):
                start = block * length
                first = np.arange(0, min(length, n - nfft - start), step)
                for begin, t, dt, z in spectra(lists[0] - start, lists[1], lists[2], first):
                    m, bins = z.shape
                    own = pa.array(np.full(m * bins, i))
                    f_ix = np.tile(np.arange(bins, dtype=np.int32), m)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        f = f_ix / (nfft * np.repeat(dt, bins))
                    yield pa.RecordBatch.from_arrays(
                        [b["shot"].take(own), b["ch_ix"].take(own), pa.array(np.repeat((start + begin) // step, bins)), pa.array(np.repeat(t, bins)), pa.array(f_ix), pa.array(f), pa.array(z.real.ravel()), pa.array(z.imag.ravel())],
                        names=["shot", "ch_ix", "win_ix", "t", "f_ix", "f", "re", "im"],
                    )

    counts = samples.groupBy("shot", "ch_ix").agg(F.count(F.lit(1)).alias("__n"))
    schema = f"shot {kinds['shot']}, ch_ix {kinds['ch_ix']}, win_ix long, t double, f_ix int, f double, re double, im double"
    return blocks.beside(blocks.packed(samples, length, nfft), counts, "shot", "ch_ix").mapInArrow(run, schema).withColumn("f", F.round("f", 4))


def spectrogram(samples: DataFrame, nfft: int = 2048, overlap: int = 0, channel: int = 0, window: str = "hann") -> DataFrame:
    """Power spectral density in decibels of one channel."""
    weights = taper_array(window, nfft)
    own = samples.where(F.col("ch_ix") == channel)
    rate = own.groupBy("shot").agg(((F.count(F.lit(1)) - 1) / (F.max("t") - F.min("t"))).alias("__rate"))
    cells = stft(own, nfft, nfft - overlap, window).join(rate, "shot")
    one_sided = F.when((F.col("f_ix") == 0) | (F.col("f_ix") == nfft / 2), 1.0).otherwise(2.0)
    power = one_sided * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * float(nfft * nfft) / (F.col("__rate") * float((weights**2).sum()))
    return cells.select("shot", "win_ix", "t", "f_ix", "f", (10 * F.log10(power)).alias("psd_db"))


def log_spectrum(spectra: DataFrame, scale: float = 1.0) -> DataFrame:
    """Spectra with their magnitude in decibels (db) and the frequency over ``scale`` (normalised)."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return spectra.withColumn("db", 20 * F.log10(size)).withColumn("normalised", F.col("f") / scale)


def mean_power(spectra: DataFrame, product: bool = False) -> DataFrame:
    """Power of each window and frequency: mean over channels of the squared magnitude, or the product of magnitudes."""
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    agg = F.exp(F.sum(F.log(F.sqrt(square)))) if product else F.avg(square)
    return spectra.groupBy("shot", "win_ix", "f_ix").agg(F.min("t").alias("t"), F.min("f").alias("f"), agg.alias("power"))


def find_peaks(power: DataFrame, n_peaks: int = 20, low: float = 0.0, high: float = float("inf"), cutoff: float = 0.0, moving: int | None = 5) -> DataFrame:
    """Spectral peaks of each window.

    Peakedness is power less its centred moving mean (edges, where the mean would reach out,
    keep the power itself as mean), or the sum of both steps if ``moving`` is None. Strict local
    maxima count, ends excluded; the ``n_peaks`` most peaked are taken first, then those of
    them inside the frequency limits and above the cutoff. Equals go to the lower frequency.
    """
    w = Window.partitionBy("shot", "win_ix").orderBy("f_ix")
    p, before, after = F.col("power"), F.lag("power").over(w), F.lead("power").over(w)
    if moving is None:
        peaked = F.abs(p - before) + F.abs(after - p)
    else:
        half = moving // 2
        around = w.rowsBetween(-half, half)
        peaked = p - F.when(F.count(F.lit(1)).over(around) == moving, F.avg("power").over(around)).otherwise(p)
    tops = power.withColumn("peak", peaked).withColumn("__top", (before < p) & (p > after)).where("__top").drop("__top")
    rank = F.row_number().over(Window.partitionBy("shot", "win_ix").orderBy(F.col("peak").desc(), "f_ix"))
    best = tops.withColumn("__rank", rank).where(F.col("__rank") <= n_peaks).drop("__rank")
    return best.where((F.col("f") > low) & (F.col("f") < high) & (F.col("peak") > cutoff))


def gather(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Complex values of all channels at each peak, in channel order."""
    cells = spectra.join(peaks.select("shot", "win_ix", "f_ix"), ["shot", "win_ix", "f_ix"])
    rows = cells.groupBy("shot", "win_ix", "f_ix").agg(F.min("t").alias("time"), F.min("f").alias("freq"), F.sort_array(F.collect_list(F.struct("ch_ix", "re", "im"))).alias("__z"))
    return rows.select("shot", "win_ix", "f_ix", "time", "freq", F.transform("__z", lambda z: complex_struct(z["re"], z["im"])).alias("amp"))


def gather_dc(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Values of all channels at frequency 0 for each peak, whatever its frequency."""
    dc = gather(spectra, peaks.select("shot", "win_ix").distinct().withColumn("f_ix", F.lit(0))).select("shot", "win_ix", F.col("amp").alias("dc"))
    return peaks.select("shot", "win_ix", "f_ix").join(dc, ["shot", "win_ix"])


def peak_freq(spectra: DataFrame, low: float = 0.0, high: float = 1e18) -> DataFrame:
    """Frequency of the largest magnitude of each window and channel within the limits; of equals the highest."""
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return spectra.where((F.col("f") >= low) & (F.col("f") <= high)).groupBy("shot", "ch_ix", "win_ix").agg(F.max_by("f", F.struct(size, "f_ix")).alias("freq"), F.max_by("f_ix", F.struct(size, "f_ix")).alias("f_ix"))


def cross_power(spectra: DataFrame, first: int, second: int) -> DataFrame:
    """Spectrum of one channel times the conjugate of another's."""
    key = ["shot", "win_ix", "f_ix"]
    a = spectra.where(F.col("ch_ix") == first).select(*key, "f", F.struct("re", "im").alias("a"))
    b = spectra.where(F.col("ch_ix") == second).select(*key, F.struct("re", "im").alias("b"))
    re = F.col("a.re") * F.col("b.re") + F.col("a.im") * F.col("b.im")
    im = F.col("a.im") * F.col("b.re") - F.col("a.re") * F.col("b.im")
    return a.join(b, key).select(*key, "f", re.alias("re"), im.alias("im"))


def spectrum_at(spectra: DataFrame, points: DataFrame) -> DataFrame:
    """Complex channel vector at the cell nearest to each point (id, shot, time, freq); the first of equals.

    Times and frequencies of the cells form a grid, so that each is looked up on its own.
    """
    from tideline.operators.interpolate import nearest

    wins = nearest(points.select("id", "shot", "time", "freq"), spectra.select("shot", "t").distinct(), "shot", "time", "t")
    cells = nearest(wins, spectra.select("shot", "f").distinct(), "shot", "freq", "f")
    rows = spectra.join(cells, ["shot", "t", "f"])
    out = rows.groupBy("id").agg(F.min("t").alias("t"), F.min("f").alias("f"), F.sort_array(F.collect_list(F.struct("ch_ix", "re", "im"))).alias("__z"))
    return out.select("id", "t", "f", F.transform("__z", lambda z: complex_struct(z["re"], z["im"])).alias("amp"))
