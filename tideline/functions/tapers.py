"""Window tapers as expressions of the sample number."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.bessel import i0e

# Cosine terms of the tapers, c0 + c1 cos(x) + c2 cos(2x) + ...
COSINES = {
    "none": (1.0,),
    "hamming": (0.54, -0.46),
    "hann": (0.5, -0.5),
    "blackman": (0.42, -0.5, 0.08),
    "flat_top": (1.0, -1.93, 1.29, -0.388, 0.032),
}
NAMES = (*COSINES, "bartlett", "kaiser", "wider")
KAISER = 3 * math.pi


def taper(name: str, k: Column, n: int) -> Column:
    """Value of the symmetric taper of length ``n`` at sample ``k``."""
    x = 2 * math.pi * k / (n - 1)
    if name in COSINES:
        return sum((c * F.cos(j * x) for j, c in enumerate(COSINES[name][1:], 1)), F.lit(COSINES[name][0]))
    if name == "bartlett":
        return 1 - F.abs(2.0 * k / (n - 1) - 1)
    if name == "wider":
        return F.sqrt(F.sqrt(1 - F.cos(x)))
    if name == "kaiser":
        inside = KAISER * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(2.0 * k / (n - 1) - 1, 2)))
        return i0e(inside) * F.exp(inside - KAISER) / i0e(F.lit(KAISER))
    raise ValueError(f"unknown taper {name!r}; known are {', '.join(NAMES)}")


def taper_array(name: str, n: int) -> np.ndarray:
    """The whole taper for the Arrow kernels."""
    k = np.arange(n)
    x = 2 * np.pi * k / max(n - 1, 1)
    if name in COSINES:
        return sum(c * np.cos(j * x) for j, c in enumerate(COSINES[name])) + np.zeros(n)
    if name == "bartlett":
        return 1 - np.abs(2 * k / (n - 1) - 1)
    if name == "wider":
        return np.sqrt(np.sqrt(np.maximum(0, 1 - np.cos(x))))
    if name == "kaiser":
        return np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (2 * k / (n - 1) - 1) ** 2))) / np.i0(KAISER)
    raise ValueError(f"unknown taper {name!r}; known are {', '.join(NAMES)}")
