"""The data behind each plot. Every report returns a DataFrame; nothing is drawn.

Clusters of no more than ``LEAST`` members are left out where members are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import angles, geometry
from tideline.functions.bessel import normal_pdf, von_mises_pdf
from tideline.operators import blocks, signals, spectral, statistics
from tideline.registry import report

LEAST = 10


def large(features: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows of clusters with more than ``least`` members."""
    sizes = features.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select("cluster")
    return features.join(sizes, "cluster", "left_semi")


def place(column: str, name: str = "dim", value: str = "x") -> Column:
    return F.posexplode(column).alias(name, value)


@report
def rep_signals(samples: DataFrame, every: int = 1) -> DataFrame:
    return signals.downsample(samples, every).select("shot", "ch_ix", "sample_ix", "t", "value")


@report
def rep_spectrogram(samples: DataFrame, nfft: int = 2048, overlap: int = 0, channel: int = 0) -> DataFrame:
    return spectral.spectrogram(samples, nfft, overlap, channel)


@report
def rep_fs_phase(found: DataFrame, closed: bool = True) -> DataFrame:
    """Phase steps of structures by place; closed curves begin with their last value."""
    d = F.col("dphase")
    shown = F.concat(F.slice(d, -1, 1), d) if closed else d
    return found.select("shot", "seg_ix", "fs_ix", F.posexplode(shown).alias("place", "dphase"))


@report
def rep_svd(decomposed: DataFrame) -> DataFrame:
    """Singular values, shares and entropy of each segment by number."""
    return decomposed.select("shot", "seg_ix", "entropy", F.posexplode(F.arrays_zip("svs", "p")).alias("number", "z")).select("shot", "seg_ix", "number", "z.svs", "z.p", "entropy")


@report
def rep_svd_topos(decomposed: DataFrame) -> DataFrame:
    """The weight of each channel in each singular vector."""
    numbered = decomposed.select("shot", "seg_ix", F.posexplode("topos").alias("number", "topo"))
    return numbered.select("shot", "seg_ix", "number", F.posexplode("topo").alias("ch_ix", "topo"))


@report
def rep_svd_spectra(decomposed: DataFrame, dt: float, fmax: float | None = None) -> DataFrame:
    """Magnitude of the transformed chronos of each segment by frequency in kHz, up to ``fmax`` if given."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n, size = len(r.chrono), np.abs(np.fft.rfft(r.chrono))
                khz = np.arange(len(size)) / (n * dt * 1000)
                at = np.flatnonzero(khz <= (np.inf if fmax is None else fmax))
                yield pd.DataFrame({"shot": r.shot, "seg_ix": r.seg_ix, "number": r.number, "f_ix": at, "f_khz": khz[at], "magnitude": size[at]})

    kinds = dict(decomposed.dtypes)
    chronos = decomposed.select("shot", "seg_ix", F.posexplode("chronos").alias("number", "chrono"))
    return chronos.mapInPandas(run, f"shot {kinds['shot']}, seg_ix {kinds['seg_ix']}, number int, f_ix int, f_khz double, magnitude double")


@report
def rep_energy(decomposed: DataFrame, chosen: tuple[int, ...]) -> DataFrame:
    """Share of energy of the chosen singular values."""
    return decomposed.select("shot", "seg_ix", F.aggregate(F.filter("p", lambda x, i: i.isin(*chosen)), F.lit(0.0), lambda a, x: a + x).alias("energy"))


@report
def rep_running_energy(decomposed: DataFrame, chosen: tuple[int, ...]) -> DataFrame:
    """Share of energy after each choice of a singular value, in order. One that is chosen again is taken off again."""
    steps = decomposed.select("shot", "seg_ix", "p", F.posexplode(F.array(*[F.lit(n) for n in chosen])).alias("step", "number"))
    before = Window.partitionBy("shot", "seg_ix", "number").orderBy("step")
    sign = F.when(F.row_number().over(before) % 2 == 1, 1.0).otherwise(-1.0)
    share = steps.withColumn("share", F.coalesce(F.get("p", F.col("number")), F.lit(0.0)) * sign)
    so_far = Window.partitionBy("shot", "seg_ix").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return share.select("shot", "seg_ix", "step", "number", F.sum("share").over(so_far).alias("energy"))


@report
def rep_pos_neg_fill(curves: DataFrame) -> DataFrame:
    """Two curves (key, x, y1, y2) cut where they cross: each part's sign, and the points that bound it.

    Zero crossings between samples are found by linear interpolation.
    """
    w = Window.partitionBy("key").orderBy("x")
    d, d0, x0 = F.col("y1") - F.col("y2"), F.lag(F.col("y1") - F.col("y2")).over(w), F.lag("x").over(w)
    y0 = F.lag("y1").over(w)
    share = d0 / (d0 - d)
    crossed = curves.withColumn("__d", d).withColumn("__at", F.when(d0 * d < 0, x0 + share * (F.col("x") - x0))).withColumn("__y", y0 + share * (F.col("y1") - y0))
    points = crossed.select("key", "x", "y1", "y2", F.signum("__d").cast("int").alias("sign"), F.lit(False).alias("crossing"))
    zeros = crossed.where("__at IS NOT NULL").select("key", F.col("__at").alias("x"), F.col("__y").alias("y1"), F.col("__y").alias("y2"), F.lit(0).alias("sign"), F.lit(True).alias("crossing"))
    return points.unionByName(zeros)


@report
def rep_join_ends(rows: DataFrame, column: str, add: float = 0.0) -> DataFrame:
    return rows.withColumn(column, angles.join_ends(F.col(column), add))


def total_phase(phases: Column) -> Column:
    """Sum of the phase steps in turns around -pi, held to [-6 pi, -2 pi]."""
    total = F.aggregate(phases, F.lit(0.0), lambda a, x: a + angles.modtwopi(x, -math.pi))
    return F.greatest(F.lit(-6 * math.pi), F.least(F.lit(-2 * math.pi), total))


@report
def rep_time_freq(features: DataFrame) -> DataFrame:
    return large(features).select("instance_id", "cluster", "time", "freq", total_phase(F.col("phases")).alias("total_phase"))


@report
def rep_kh_freq(features: DataFrame, kh: str = "kh") -> DataFrame:
    return large(features).select("instance_id", "cluster", F.col(kh).alias("kh"), (F.col("freq") / 1000).alias("freq_khz"), total_phase(F.col("phases")).alias("total_phase"))


@report
def rep_vm_distributions(features: DataFrame, clusters: DataFrame, points: int = 300, bins: int = 359) -> DataFrame:
    """Density histogram of each cluster and dimension beside the fitted density at the middle of each bin."""
    rows = statistics.long_phases(large(features).select("instance_id", "cluster", "phases"))
    counts = statistics.histogram(rows, "cluster", "dim", bins=bins)
    x = F.lit(-math.pi) + (F.col("bin") + 0.5) * (2 * math.pi / bins)
    return counts.join(clusters.select("cluster", "dim", "mu", "kappa"), ["cluster", "dim"]).select("cluster", "dim", "bin", "count", "density", von_mises_pdf(x, F.col("mu"), F.col("kappa")).alias("fitted"))


@report
def rep_gmm_gmm_distributions(parameters: DataFrame, points: int = 300, low: float = -math.pi, high: float = math.pi) -> DataFrame:
    """Normal densities of the real and imaginary parts (cluster, dim, mean, std) on a grid."""
    grid = parameters.select("cluster", "dim", "mean", "std", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    return grid.select("cluster", "dim", "i", x.alias("x"), normal_pdf(x, F.col("mean"), F.col("std")).alias("density"))


@report
def rep_dim_hist(features: DataFrame, clusters: DataFrame, bins: int = 180) -> DataFrame:
    """Density of each dimension over all rows, and the mixture density at the middle of each bin."""
    rows = statistics.long_phases(features.select("instance_id", "phases"))
    counts = statistics.histogram(rows, "dim", bins=bins)
    weight = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    grid = clusters.withColumn("w", weight).select("dim", "mu", "kappa", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    x = F.lit(-math.pi) + (F.col("bin") + 0.5) * (2 * math.pi / bins)
    curve = grid.groupBy("dim", "bin").agg(F.sum(F.col("w") * von_mises_pdf(x, F.col("mu"), F.col("kappa"))).alias("mixture"))
    return curve.join(counts, ["dim", "bin"], "left").select("dim", "bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("density", F.lit(0.0)).alias("density"), "mixture")


def with_mixture(counts: DataFrame, parameters: DataFrame | None, *keys: str, low: float, high: float, bins: int) -> DataFrame:
    """Every bin with the density at its middle of a mixture of normal clusters (keys, mean, std and n, whose share is a cluster's weight); the counts alone without parameters."""
    if parameters is None:
        return counts
    whole = parameters.groupBy(*keys).agg(F.sum("n").alias("__all"))
    grid = parameters.join(whole, [*keys]).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    x = F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / bins)
    curve = grid.groupBy(*keys, "bin").agg(F.sum(F.col("n") / F.col("__all") * normal_pdf(x, F.col("mean"), F.col("std"))).alias("mixture"))
    return curve.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("density", F.lit(0.0)).alias("density"), "mixture")


def complex_parts(features: DataFrame) -> DataFrame:
    """cluster (if there is one), dim, part (re or im) and v: the complex values over their row's sum."""
    rest = [c for c in ("cluster",) if c in features.columns]
    z = features.select(*rest, F.posexplode(angles.over_sum(F.col("amp"))).alias("dim", "z"))
    return z.select(*rest, "dim", F.explode(F.array(F.struct(F.lit("re").alias("part"), F.col("z.re").alias("v")), F.struct(F.lit("im").alias("part"), F.col("z.im").alias("v")))).alias("p")).select(*rest, "dim", "p.part", "p.v")


def neighbour_ratios(features: DataFrame) -> DataFrame:
    """cluster (if there is one), dim, v (signed amplitude) and angle of the ratio of neighbours."""
    rest = [c for c in ("cluster",) if c in features.columns]
    z = features.select(*rest, F.posexplode(angles.adjacent_ratio(F.col("amp"))).alias("dim", "z"))
    return z.select(*rest, "dim", angles.signed_amplitude(F.col("z")).alias("v"), F.atan2("z.im", "z.re").alias("angle"))


def amplitude_shares(features: DataFrame) -> DataFrame:
    """cluster (if there is one), dim and v: the magnitudes over their row's sum."""
    rest = [c for c in ("cluster",) if c in features.columns]
    rows = features.select(*rest, magnitudes(F.col("amp")).alias("m"))
    return rows.select(*rest, F.posexplode(over(F.col("m"), array_sum(F.col("m")))).alias("dim", "v"))


@report
def rep_dim_hist_gmm_gmm(features: DataFrame, bins: int = 180, parameters: DataFrame | None = None) -> DataFrame:
    """Densities of the real and imaginary parts over the channel sum, with the mixture of the parameters (cluster, dim, part, mean, std, n) if given."""
    counts = statistics.histogram(complex_parts(features).select("dim", "part", "v"), "dim", "part", value="v", bins=bins)
    return with_mixture(counts, parameters, "dim", "part", low=-math.pi, high=math.pi, bins=bins)


@report
def rep_dim_hist_vmm_gmm(features: DataFrame, bins: int = 180, low: float = -5.0, high: float = 5.0, parameters: DataFrame | None = None) -> DataFrame:
    """Densities of the signed amplitude ratio of neighbours, with the mixture of the parameters (cluster, dim, mean, std, n) if given."""
    counts = statistics.histogram(neighbour_ratios(features).select("dim", "v"), "dim", value="v", low=low, high=high, bins=bins)
    return with_mixture(counts, parameters, "dim", low=low, high=high, bins=bins)


@report
def rep_ratio_angle_hist(features: DataFrame, bins: int = 180) -> DataFrame:
    """Densities of the angle of the ratio of neighbours."""
    return statistics.histogram(neighbour_ratios(features).select("dim", "angle"), "dim", value="angle", bins=bins)


def magnitudes(amps: Column) -> Column:
    return F.transform(amps, lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))


def over(a: Column, total: Column) -> Column:
    return F.transform(a, lambda x: x / total)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


@report
def rep_dim_hist_amps(features: DataFrame, bins: int = 180, parameters: DataFrame | None = None) -> DataFrame:
    """Densities on [0, 1] of the magnitudes over their row's sum, with the mixture of the parameters (cluster, dim, mean, std, n) if given."""
    counts = statistics.histogram(amplitude_shares(features).select("dim", "v"), "dim", value="v", low=0.0, high=1.0, bins=bins)
    return with_mixture(counts, parameters, "dim", low=0.0, high=1.0, bins=bins)


@report
def rep_phase_vs_phase(features: DataFrame, clusters: DataFrame, cutoff: float = 0.0, every: int = 1) -> DataFrame:
    """Neighbouring dimensions against each other, for clusters of a mean concentration above the cutoff."""
    rows = features.join(statistics.passing(clusters, cutoff, "kappa").select("cluster"), "cluster", "left_semi").where(F.pmod(F.col("instance_id"), F.lit(every)) == 0)
    pairs = F.zip_with(F.slice("phases", 1, F.size("phases") - 1), F.slice("phases", 2, F.size("phases") - 1), lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return rows.select("instance_id", "cluster", F.posexplode(pairs).alias("dim", "p")).select("instance_id", "cluster", "dim", "p.x", "p.y")


@report
def rep_phase_lines(features: DataFrame, clusters: DataFrame, cutoff: float = 0.0, cumulative: bool = False) -> DataFrame:
    """Phases taken to within half a turn of their cluster's mean; as running sums in turns if asked."""
    good = statistics.passing(clusters, cutoff, "kappa").select("cluster")
    means = clusters.join(good, "cluster", "left_semi").select("cluster", "dim", "mu")
    rows = statistics.long_phases(large(features).select("instance_id", "cluster", "phases")).join(means, ["cluster", "dim"])
    out = rows.select("instance_id", "cluster", "dim", angles.modtwopi(F.col("phase"), F.col("mu")).alias("phase"))
    if not cumulative:
        return out
    w = Window.partitionBy("instance_id", "cluster").orderBy("dim").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("phase", F.sum("phase").over(w) / (2 * math.pi))


@report
def rep_polarisation(features: DataFrame, responses: DataFrame, frames: DataFrame) -> DataFrame:
    """Three-axis vectors corrected for the coils' response, normalised, turned to cartesian axes and projected on field directions.

    ``features`` has instance_id, coil and axes (array of three complex values); ``responses``
    coil and gain (array of three complex values); ``frames`` coil and rotation (three rows of
    three numbers) and field (unit vector). Returns the complex projection and its polar form.
    """
    rows = features.join(responses, "coil").join(frames, "coil")
    fixed = F.zip_with("axes", "gain", angles.divide)
    size = F.sqrt(F.aggregate(fixed, F.lit(0.0), lambda a, z: a + z["re"] * z["re"] + z["im"] * z["im"]))

    def dot(row: Column, part: str) -> Column:
        return F.aggregate(F.zip_with(row, "__v", lambda r, z: r * z[part]), F.lit(0.0), lambda a, x: a + x)

    rows = rows.withColumn("__v", F.transform(fixed, lambda z: angles.complex_struct(z["re"] / size, z["im"] / size)))
    turned = F.transform("rotation", lambda row: angles.complex_struct(dot(row, "re"), dot(row, "im")))
    rows = rows.withColumn("__t", turned)
    along = {part: F.aggregate(F.zip_with("field", F.transform("__t", lambda z: z.getField(part)), lambda f, x: f * x), F.lit(0.0), lambda a, x: a + x) for part in ("re", "im")}
    return rows.select("instance_id", "coil", along["re"].alias("re"), along["im"].alias("im"), angles.magnitude(along["re"], along["im"]).alias("radius"), F.atan2(along["im"], along["re"]).alias("angle"))


def profile(features: DataFrame, values: Column) -> DataFrame:
    """Mean and deviation of an array over each cluster, by place."""
    rows = large(features).select("cluster", F.posexplode(values).alias("dim", "v"))
    return rows.groupBy("cluster", "dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


@report
def rep_amp_lines(features: DataFrame) -> DataFrame:
    """Cluster profiles of the magnitudes over their row's mean."""
    m = magnitudes(F.col("amp"))
    return profile(features, over(m, array_sum(m) / F.size(m)))


@report
def rep_re_im_lines(features: DataFrame) -> DataFrame:
    """Cluster profiles of the complex values over their row's sum."""
    rows = large(features).select("cluster", F.posexplode(angles.over_sum(F.col("amp"))).alias("dim", "z"))
    return rows.groupBy("cluster", "dim").agg(F.avg("z.re").alias("re"), F.avg("z.im").alias("im"))


@report
def rep_fft_amp_lines(features: DataFrame, channels: int) -> DataFrame:
    """Magnitudes of the spatial transform of each row over their largest; a direct sum, as channels are few."""
    rows = large(features)
    parts = []
    for k in range(channels):
        a = 2 * math.pi * k / channels
        re = F.aggregate(F.zip_with("amp", F.sequence(F.lit(0), F.lit(channels - 1)), turned_re(a)), F.lit(0.0), lambda s, x: s + x)
        im = F.aggregate(F.zip_with("amp", F.sequence(F.lit(0), F.lit(channels - 1)), turned_im(a)), F.lit(0.0), lambda s, x: s + x)
        parts.append(F.sqrt(re * re + im * im))
    m = rows.select("instance_id", "cluster", F.array(*parts).alias("m"))
    return m.select("instance_id", "cluster", F.posexplode(over(F.col("m"), F.array_max("m"))).alias("k", "amp"))


def turned_re(a: float):
    return lambda z, i: z["re"] * F.cos(a * i) + z["im"] * F.sin(a * i)


def turned_im(a: float):
    return lambda z, i: z["im"] * F.cos(a * i) - z["re"] * F.sin(a * i)


@report
def rep_interferometer(features: DataFrame) -> DataFrame:
    """Mean and deviation of each channel's magnitude over its row's norm, for rows of above-average rms in their cluster."""
    m = magnitudes(F.col("amp"))
    norm = F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + x * x))
    rows = large(features).withColumn("__norm", norm).withColumn("__rms", F.col("__norm") / F.sqrt(F.size("amp")))
    loud = blocks.beside(rows, rows.groupBy("cluster").agg(F.avg("__rms").alias("__mean")), "cluster").where("__rms > __mean")
    z = loud.select("cluster", F.posexplode(over(m, F.col("__norm"))).alias("dim", "v"))
    return z.groupBy("cluster", "dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


@report
def rep_single_kh(features: DataFrame, clusters: DataFrame, cutoff: float = 0.0, density: str | None = None) -> DataFrame:
    """kh and frequency (times the root of the density if asked) of the clusters that pass."""
    rows = features.join(statistics.passing(clusters, cutoff, "kappa").select("cluster"), "cluster", "left_semi")
    f = F.col("freq") * F.sqrt(density) if density else F.col("freq")
    return rows.select("instance_id", "cluster", "kh", f.alias("freq"))


@report
def rep_cumulative_phases(clusters: DataFrame) -> DataFrame:
    """Running sums of each cluster's mean phases in turns, from 0."""
    w = Window.partitionBy("cluster").orderBy("dim").rowsBetween(Window.unboundedPreceding, 0)
    sums = clusters.select("cluster", (F.col("dim") + 1).alias("place"), (F.sum("mu").over(w) / (2 * math.pi)).alias("turns"))
    return sums.unionByName(clusters.select("cluster").distinct().select("cluster", F.lit(0).alias("place"), F.lit(0.0).alias("turns")))


@report
def rep_mode_lines(spark, modes: DataFrame | None = None) -> DataFrame:
    """Running phase of the model modes along the coils, steps taken into (-1.5 pi, 0.5 pi)."""
    coils = [(i, th, ph) for i, (th, ph) in enumerate(zip(geometry.COIL_THETA[1:], geometry.COIL_PHI[1:], strict=True))]
    modes = spark.createDataFrame(geometry.MODES, "n int, m int") if modes is None else modes.select("n", "m")
    rows = modes.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(th).alias("theta"), F.lit(ph).alias("phi")) for i, th, ph in coils]))).select("n", "m", "c.*")
    w = Window.partitionBy("n", "m").orderBy("place")
    phase = F.radians(F.col("m") * F.col("theta") + F.col("n") * F.col("phi"))
    step = rows.withColumn("__p", phase).withColumn("__d", F.col("__p") - F.lag("__p").over(w))
    d = F.when(F.col("__d") < -1.5 * math.pi, F.col("__d") + 2 * math.pi).when(F.col("__d") > 0.5 * math.pi, F.col("__d") - 2 * math.pi).otherwise(F.col("__d"))
    return step.select("n", "m", "place", (F.coalesce(F.sum(d).over(w), F.lit(0.0)) / (2 * math.pi)).alias("turns"))


@report
def rep_gmm_amps(parameters: DataFrame) -> DataFrame:
    """Mean, and mean less and plus the deviation, by cluster and dimension."""
    return parameters.select("cluster", "dim", "mean", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))


@report
def rep_compare_kappas(tables: dict[str, DataFrame], by: str = "sigma_eq", most: int = 80) -> DataFrame:
    """Retention curves of several clusterings."""
    out = None
    for name, clusters in tables.items():
        one = statistics.retention(clusters, by, most).withColumn("clustering", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@report
def rep_compare_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Best match of each cluster, both ways."""
    pairs = statistics.similarity(first, second)
    a = statistics.best_matches(pairs).select(F.lit("first").alias("side"), F.col("first").alias("cluster"), "match", "common", "members")
    b = statistics.best_matches(pairs, "second", "first").select(F.lit("second").alias("side"), F.col("second").alias("cluster"), "match", "common", "members")
    return a.unionByName(b)


@report
def rep_alfven(lines: DataFrame, field: float = 0.5) -> DataFrame:
    """Frequencies of theoretical parallel wave numbers (kh, k_par)."""
    return lines.withColumn("freq", geometry.alfven_frequency(F.col("k_par"), F.lit(field)))


@report
def rep_specgram_overlay(features: DataFrame, clusters: DataFrame, shot: int, cutoff: float = 5.0) -> DataFrame:
    """Points of one shot in clusters of more than one member there and mean concentration above the cutoff."""
    rows = features.join(statistics.passing(clusters, cutoff, "kappa").select("cluster"), "cluster", "left_semi").where(F.col("shot") == shot)
    return large(rows, 1).select("cluster", "time", "freq")


@report
def rep_cluster_overlay(features: DataFrame, chosen: tuple[int, ...] = ()) -> DataFrame:
    rows = features.where(F.col("cluster").isin(*chosen)) if chosen else features
    return rows.select("cluster", "shot", "time", "freq")


@report
def rep_pinpoint(spectra: DataFrame, points: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Amplitude and phase of every channel at the cell nearest to each point, with the probe's angle or number."""
    z = spectral.spectrum_at(spectra, points).select("id", "t", "f", F.posexplode("amp").alias("ch_ix", "z"))
    out = z.select("id", "t", "f", "ch_ix", angles.magnitude(F.col("z.re"), F.col("z.im")).alias("amplitude"), F.atan2("z.im", "z.re").alias("phase"))
    if probes is None:
        return out.withColumn("probe", F.col("ch_ix").cast("double"))
    return out.join(probes.select("ch_ix", F.col("angle").cast("double").alias("probe")), "ch_ix", "left")


@report
def rep_vm_sweep(spark, n: int = 20_000, seed: int = 0, step: int = 1, piece: int = 100_000) -> DataFrame:
    """Estimated against true concentration and mean over a sweep, with the bias-corrected estimate."""
    import numpy as np
    import pandas as pd

    from tideline.operators.cluster import kappa_of, kappa_unbiased

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng, total = np.random.default_rng([seed, r.kappa, r.i]), 0j
                # The same draws in pieces, so that memory does not grow with their number.
                for start in range(0, n, piece):
                    total += np.exp(1j * rng.vonmises(r.mu, r.kappa, min(piece, n - start))).sum()
                z = total / n if n else np.nan
                out.append((r.mu, r.kappa, float(np.angle(z)), float(kappa_of(np.abs(z))), float(kappa_unbiased(np.array([abs(z)]), n)[0])))
            yield pd.DataFrame(out, columns=["mu", "kappa", "mu_fit", "kappa_fit", "kappa_lookup"])

    grid = spark.range(20).select(F.col("id").alias("i"), (F.lit(-math.pi) + F.col("id") * (2 * math.pi / 19)).alias("mu"), F.explode(F.sequence(F.lit(1), F.lit(49), F.lit(step))).alias("kappa"))
    return grid.mapInPandas(run, "mu double, kappa int, mu_fit double, kappa_fit double, kappa_lookup double")
