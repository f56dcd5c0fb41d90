"""Special functions as Column expressions and, for kernels, in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0; below 1/2 by reflection."""

    def upper(z: Column) -> Column:
        z = z - 1
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + F.lit(c) / (z + k)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)

    low = F.lit(math.log(math.pi)) - F.log(F.sin(F.lit(math.pi) * F.least(x, F.lit(0.5)))) - upper(1 - F.least(x, F.lit(0.5)))
    return F.when(x < 0.5, low).otherwise(upper(F.greatest(x, F.lit(0.5))))


def log_ncr(a: Column, b: Column) -> Column:
    """ln of the binomial coefficient, for real arguments."""
    return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)


def digamma(x: Column) -> Column:
    """Six steps of the recurrence, then the asymptotic series; x > 0."""
    shift = sum((F.lit(-1.0) / (x + k) for k in range(6)), F.lit(0.0))
    z = x + 6
    w = 1 / (z * z)
    return shift + F.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))


def dlog_ncr(a: Column, b: Column) -> Column:
    """Derivative of ``log_ncr`` by its first argument."""
    return digamma(a + 1) - digamma(a - b + 1)


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, 2)) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column) -> Column:
    """Phi(x) by the rational approximation of erfc with a fitted exponent (Numerical Recipes' erfcc, error below 1.2e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def poly_curve(x: Column, coefficients: Column) -> Column:
    """Sum of a_n x^n over an array of coefficients."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, a: s * x + a)


def fourier_series(x: Column, coefficients: Column, frequency: Column) -> Column:
    """a0/2 + sum of a_n sin(n w x) + b_n cos(n w x); coefficients are a0, a1, b1, a2, b2, ..."""
    n = ((F.size(coefficients) - 1) / 2).cast("int")
    terms = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(0))),
        lambda k: F.when(k == 0, F.get(coefficients, F.lit(0)) / 2).otherwise(F.get(coefficients, 2 * k - 1) * F.sin(k * frequency * x) + F.get(coefficients, 2 * k) * F.cos(k * frequency * x)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """ln Gamma for arrays of positive numbers: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = z < 8
        shift = shift - np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    w = 1 / (z * z)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def digamma_np(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = z < 8
        shift = shift - np.where(low, 1 / z, 0.0)
        z = np.where(low, z + 1, z)
    w = 1 / (z * z)
    return shift + np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240)))


def trigamma_np(x: np.ndarray) -> np.ndarray:
    """The derivative of digamma, by its recurrence and the series for large arguments."""
    x = np.asarray(x, float)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(12):
        low = z < 12
        shift = shift + np.where(low, 1 / (z * z), 0.0)
        z = np.where(low, z + 1, z)
    w = 1 / (z * z)
    return shift + 1 / z + w / 2 + w / z * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))
