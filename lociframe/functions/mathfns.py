"""Special functions and log densities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling series coefficients B_2k / (2k (2k-1)).
_STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
_SHIFT = 12


def _stirling(z: Column) -> Column:
    series = F.lit(0.0)
    for c in reversed(_STIRLING):
        series = (series + F.lit(c)) / (z * z) if c is not _STIRLING[0] else (series + F.lit(c)) / z
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0.

    Stirling's series on the argument shifted above 12; the shift divides by
    the rising product, whose log is taken once.
    """
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    return F.when(x > _SHIFT, _stirling(x)).otherwise(_stirling(x + _SHIFT) - F.log(product))


def log_pdf_gamma(x: Column, a: Column, b: Column) -> Column:
    return a * F.log(b) - lgamma(a) + (a - 1) * F.log(x) - b * x


def log_pdf_invgamma(x: Column, a: Column, b: Column) -> Column:
    return a * F.log(b) - lgamma(a) - (a + 1) * F.log(x) - b / x


def log_pdf_beta(x: Column, a: Column, b: Column) -> Column:
    return lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * F.log(x) + (b - 1) * F.log(1 - x)


def log_pdf(dist: str, x: Column, a: Column, b: Column) -> Column:
    return {"gamma": log_pdf_gamma, "invgamma": log_pdf_invgamma, "beta": log_pdf_beta}[dist](x, a, b)


def beta_from_moments(mean: Column, var: Column) -> tuple[Column, Column]:
    """(p, q) of a beta with the given moments; p+q is 0.01 when they fit none."""
    z = mean * (1 - mean) / var - 1
    z = F.when(z <= 0, F.lit(0.01)).otherwise(z)
    return mean * z, (1 - mean) * z


def gamma_from_moments(mean: Column, var: Column) -> tuple[Column, Column]:
    return mean * mean / var, mean / var


def lowest_bit(mask: Column) -> Column:
    """The lowest set bit of a mask, as a mask."""
    return mask.bitwiseAND(-mask)


def drop_lowest_bit(mask: Column) -> Column:
    return mask.bitwiseAND(mask - 1)


def log_factorial(n: Column) -> Column:
    return lgamma(n.cast("double") + 1)
