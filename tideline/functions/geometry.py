"""Coordinates, probe angles and field-line formulas of the supported devices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.bessel import horner

# Angles of the probes in degrees.
TOROIDAL = (20.0, 67.0, 97.0, 127.0, 132.0, 137.0, 157.0, 200.0, 247.0, 277.0, 307.0, 312.0, 322.0, 340.0)
POLOIDAL = (
    0.0, 18.4, 36.0, 48.7, 59.2, 69.6, 78.0, 85.1, 93.4, 100.7, 107.7, 114.9, 121.0, 129.2, 143.6, 165.3, 180.1, 195.0, 216.3, 230.8, 238.9,
    244.9, 253.5, 262.1, 271.1, 279.5, 290.6, 300.6, 311.8, 324.2, 341.9,
)
ARRAYS = {"toroidal": TOROIDAL, "poloidal": POLOIDAL}

# Approximate coil angles in Boozer coordinates (degrees), and the modes drawn with them as (n, m).
COIL_THETA = (297.165, 268.283, 239.198, 211.107, 185.257, 160.934, 137.809, 114.798, 92.381, 70.123, 46.695, 21.438, -5.049, -32.694, -61.366, -90.180)
COIL_PHI = (46.742, 37.825, 28.680, 19.329, 9.922, 0.604, -8.267, -16.854, -24.904, -32.505, -40.037, -47.792, -55.819, -64.136, -72.807, -81.693)
MODES = ((-4, 3), (-5, 4), (-6, 5))

# Fixed values of the field-line speed: vacuum permeability, ion mass (kg), effective mass number, scale.
MU0, ION_MASS, EFFECTIVE_MASS, SCALE = 4e-7 * math.pi, 1.673e-27, 2.5, 0.27


def polynomial_angle(kh: Column, coefficients: tuple[float, ...]) -> Column:
    """Magnetic angle of a coil: a polynomial in kh, highest power first."""
    return horner(tuple(reversed(coefficients)), kh)


def to_magnetic(kh: Column, coefficients: tuple[float, ...]) -> Column:
    return F.struct(polynomial_angle(kh, coefficients).alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))


def magnetic_by_coil(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Rows (coil, kh) with their magnetic coordinates z, by the polynomial of their coil (coil, coefficients, highest power first)."""
    value = F.aggregate("coefficients", F.lit(0.0), lambda acc, c: acc * F.col("kh") + c)
    z = F.struct(value.alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))
    return rows.join(coefficients, "coil").select(*rows.columns, z.alias("z"))


def probes(spark: SparkSession) -> DataFrame:
    """Angle of each probe of each array: probes (the array's name), ch_ix, angle in degrees."""
    return spark.createDataFrame([(n, i, a) for n, angles in ARRAYS.items() for i, a in enumerate(angles)], "probes string, ch_ix int, angle double")


def parse_coords(text: Column) -> Column:
    """Three numbers of a text such as "0.1, 2, 3"."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))
    return F.struct(F.get(p, F.lit(0)).alias("c1"), F.get(p, F.lit(1)).alias("c2"), F.get(p, F.lit(2)).alias("c3"))


def alfven_speed(b: Column, number_density: float = 1e18) -> Column:
    """Field over the root of mass density times permeability, scaled."""
    return b / math.sqrt(number_density * EFFECTIVE_MASS * ION_MASS * MU0) * SCALE


def alfven_frequency(k_par: Column, b: Column) -> Column:
    return k_par * alfven_speed(b) / (2 * math.pi)
