"""Modified Bessel functions and the densities built on them, as column expressions.

Polynomials of Abramowitz and Stegun, 9.8.1 to 9.8.4, in the form scaled by exp(-x).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published polynomial coefficients, in rising powers.
I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)
I1_SMALL = (0.5, 0.87890594, 0.51498869, 0.15084934, 0.02658733, 0.00301532, 0.00032411)
I1_LARGE = (0.39894228, -0.03988024, -0.00362018, 0.00163801, -0.01031555, 0.02282967, -0.02895312, 0.01787654, -0.00420059)
TURN = 3.75


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def i0e(x: Column) -> Column:
    """I0(x) exp(-x) for x >= 0."""
    small = horner(I0_SMALL, F.pow(x / TURN, 2)) * F.exp(-x)
    return F.when(x < TURN, small).otherwise(horner(I0_LARGE, TURN / x) / F.sqrt(x))


def i1e(x: Column) -> Column:
    """I1(x) exp(-x) for x >= 0."""
    small = x * horner(I1_SMALL, F.pow(x / TURN, 2)) * F.exp(-x)
    return F.when(x < TURN, small).otherwise(horner(I1_LARGE, TURN / x) / F.sqrt(x))


def ln(x: Column) -> Column:
    """Natural logarithm as doubles have it: -inf of 0 and NaN below; Spark's own gives nulls there, which averages would leave out."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def log_i0(x: Column) -> Column:
    return F.log(i0e(x)) + x


def kappa_to_std(kappa: Column, degrees: bool = False) -> Column:
    """Circular standard deviation sqrt(-2 ln(I1/I0)); infinite at 0."""
    std = F.sqrt(-2 * ln(i1e(kappa) / i0e(kappa)))
    return F.degrees(std) if degrees else std


def von_mises_pdf(x: Column, mu: Column, kappa: Column) -> Column:
    return F.exp(kappa * (F.cos(x - mu) - 1)) / (2 * math.pi * i0e(kappa))


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    return F.exp(-F.pow((x - mean) / std, 2) / 2) / (std * math.sqrt(2 * math.pi))


def sql_i0e(x: str) -> str:
    return f"CASE WHEN {x} < 3.75 THEN {sql_horner(I0_SMALL, f'pow({x} / 3.75, 2)')} * exp(-{x}) ELSE {sql_horner(I0_LARGE, f'(3.75 / {x})')} / sqrt({x}) END"


def sql_i1e(x: str) -> str:
    return f"CASE WHEN {x} < 3.75 THEN {x} * {sql_horner(I1_SMALL, f'pow({x} / 3.75, 2)')} * exp(-{x}) ELSE {sql_horner(I1_LARGE, f'(3.75 / {x})')} / sqrt({x}) END"


def sql_horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[-1]}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c}::DOUBLE)"
    return out
