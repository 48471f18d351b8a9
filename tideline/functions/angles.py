"""Angles, complex numbers and circular statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap_pi(x: Column) -> Column:
    """Into (-pi, pi]."""
    y = F.pmod(x, F.lit(TWO_PI))
    return F.when(y > math.pi, y - TWO_PI).otherwise(y)


def modtwopi(x: Column, offset: Column | float = 0.0) -> Column:
    """Into [offset - pi, offset + pi)."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    return F.pmod(x - offset + math.pi, F.lit(TWO_PI)) + offset - math.pi


def remap_periodic(x: Column, least: float, period: float = TWO_PI) -> Column:
    """Shifted by whole periods into [least, least + period)."""
    return F.pmod(x - least, F.lit(float(period))) + least


def angle(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def complex_struct(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def conjugate(z: Column) -> Column:
    return complex_struct(z["re"], -z["im"])


def multiply(a: Column, b: Column) -> Column:
    return complex_struct(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_struct((a["re"] * b["re"] + a["im"] * b["im"]) / size, (a["im"] * b["re"] - a["re"] * b["im"]) / size)


def signed_amplitude(z: Column) -> Column:
    """Magnitude, negative where the angle is."""
    size = magnitude(z["re"], z["im"])
    return F.when(F.atan2(z["im"], z["re"]) < 0, -size).otherwise(size)


def adjacent_ratio(amps: Column) -> Column:
    """Each element of an array of complex numbers over its predecessor."""
    return F.zip_with(F.slice(amps, 2, F.size(amps) - 1), F.slice(amps, 1, F.size(amps) - 1), divide)


def reference_ratio(amps: Column, channel: int) -> Column:
    """Each element over the one of a reference channel (from 0)."""
    return F.transform(amps, lambda z: divide(z, F.get(amps, F.lit(channel))))


def complex_sum(amps: Column) -> Column:
    zero = complex_struct(F.lit(0.0), F.lit(0.0))
    return F.aggregate(amps, zero, lambda acc, z: complex_struct(acc["re"] + z["re"], acc["im"] + z["im"]))


def over_sum(amps: Column) -> Column:
    """Each element over the sum of all."""
    return F.transform(amps, lambda z: divide(z, complex_sum(amps)))


def over_mean(amps: Column) -> Column:
    total = complex_sum(amps)
    n = F.size(amps).cast("double")
    return F.transform(amps, lambda z: divide(z, complex_struct(total["re"] / n, total["im"] / n)))


def differences(a: Column) -> Column:
    """Consecutive differences of an array."""
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)


def phase_steps(phases: Column) -> Column:
    """Consecutive differences wrapped into (-pi, pi]."""
    return F.transform(differences(phases), wrap_pi)


def cumulative(a: Column) -> Column:
    """Running sums of an array."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
    return F.aggregate(a, start, step, lambda acc: acc["out"])


def zero_small(phases: Column, least: float = 0.001) -> Column:
    """Phases smaller than ``least`` become 0."""
    return F.transform(phases, lambda x: F.when(F.abs(x) < least, 0.0).otherwise(x))


def embedded(phases: Column) -> Column:
    """Cosine and sine of each angle, one after the other."""
    return F.flatten(F.transform(phases, lambda x: F.array(F.cos(x), F.sin(x))))


def join_ends(a: Column, add: float = 0.0) -> Column:
    """The array with its first element, moved by ``add``, appended."""
    return F.concat(a, F.array(F.get(a, F.lit(0)) + F.lit(float(add))))


def kappa_from_r(r: Column) -> Column:
    """Concentration of a von Mises distribution from its mean resultant length, by the usual three-piece approximation."""
    low = 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6
    middle = -0.4 + 1.39 * r + 0.43 / (1 - r)
    high = 1 / (2 * (1 - r))
    return F.when(r < 0.53, low).when(r < 0.85, middle).otherwise(high)


def clipped_kappa(r: Column, least: float = 0.1, most: float = 300.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), kappa_from_r(F.least(r, F.lit(1 - 1e-9)))))


def resultant(phase: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: mean cosine and mean sine, weighted over the number of rows."""
    w = weight if weight is not None else F.lit(1.0)
    return F.sum(w * F.cos(phase)) / F.count(phase), F.sum(w * F.sin(phase)) / F.count(phase)
