"""Logarithm of the gamma function and its derivative, for positive arguments."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8  # recurrences up to where the asymptotic series hold twelve digits
# Coefficients of the two asymptotic series, by rising odd powers of 1/x and even ones.
_LOG_GAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)


def _series(coefficients: tuple[float, ...], square: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * square + c
    return out


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of ``x``; NULL unless x is positive."""
    z = x + _SHIFT
    below = F.lit(1.0)
    for k in range(_SHIFT):
        below = below * (x + k)
    value = (z - 0.5) * F.ln(z) - z + log(2 * pi) / 2 + _series(_LOG_GAMMA, 1 / (z * z)) / z - F.ln(below)
    return F.when(x > 0, value)


def digamma(x: Column) -> Column:
    """Derivative of ``log_gamma``; NULL unless x is positive."""
    z = x + _SHIFT
    below = sum((1 / (x + k) for k in range(_SHIFT)), F.lit(0.0))
    return F.when(x > 0, F.ln(z) - 1 / (2 * z) + _series(_DIGAMMA, 1 / (z * z)) / (z * z) - below)
