"""Special functions that Spark SQL lacks, as Arrow-batched UDFs over numpy."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

P_FLOOR = 1e-300
_inv = NormalDist().inv_cdf


def _each(f, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel()], float).reshape(x.shape)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return _each(math.erfc, x)


def gamma_q_np(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: series of P below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    low, high = ok & (x > 0) & (x < a + 1), ok & (x >= a + 1) & np.isfinite(x)
    out[ok & np.isinf(x)] = 0.0
    if low.any():
        s, y = a[low], x[low]
        term = 1 / s
        total, n = term.copy(), s.copy()
        for _ in range(100_000):
            n = n + 1
            term = term * y / n
            total += term
            if (term <= total * 1e-17).all():
                break
        out[low] = 1 - total * np.exp(s * np.log(y) - y - _lgamma(s))
    if high.any():
        s, y = a[high], x[high]
        tiny = 1e-300
        b = y + 1 - s
        c, d = np.full(s.shape, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 4e-16).all():
                break
        out[high] = np.exp(s * np.log(y) - y - _lgamma(s)) * h
    return out


def norm_sf_np(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def norm_ppf_np(p: np.ndarray) -> np.ndarray:
    edge = lambda v: -math.inf if v == 0 else math.inf if v == 1 else math.nan if not 0 < v < 1 else _inv(v)
    return np.array([edge(v) for v in np.asarray(p, float)])


#: From this a on, and this close to the middle (in eta), Temme's expansion holds to the last bits of a double.
TEMME_A, TEMME_ETA = 100.0, 0.6


@cache
def _temme(orders: int = 8, powers: int = 24) -> np.ndarray:
    """Coefficients of Temme's uniform expansion: row k is the polynomial in eta that goes with a**-k."""
    top = powers + 2 * orders + 3
    alpha = [Fraction(0), Fraction(1)]
    for n in range(2, top):
        alpha.append((alpha[n - 1] - sum((j * alpha[j] * alpha[n - j + 1] for j in range(2, n)), Fraction(0))) / (n + 1))
    # Stirling's coefficients of gamma: g_k = (1 * 3 * ... * (2k - 1)) * (2k + 1) alpha_(2k + 1).
    g = [math.prod(range(1, 2 * k, 2)) * (2 * k + 1) * alpha[2 * k + 1] for k in range(orders)]
    d = [[(n + 2) * alpha[n + 2] - (n == 0) for n in range(top - 2)]]
    for k in range(1, orders):
        d.append([(-1) ** k * g[k] * d[0][n] + (n + 2) * d[-1][n + 2] for n in range(len(d[-1]) - 2)])
    return np.array([[float(v) for v in row[:powers]] for row in d])


def _eta(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number whose half square is x / a - 1 - ln(x / a), with the sign of x - a."""
    m = (x - a) / a
    return np.sign(m) * np.sqrt(2 * np.maximum(m - np.log1p(m), 0))


def gamma_q_middle_np(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for a from TEMME_A on and x near a, in a number of steps that doesn't grow with a."""
    eta = _eta(a, x)
    inner = [np.polynomial.polynomial.polyval(eta, row) for row in _temme()]
    rest = sum(v / a**k for k, v in enumerate(inner))
    return 0.5 * _erfc(eta * np.sqrt(a / 2)) + np.exp(-a * eta * eta / 2) / np.sqrt(2 * math.pi * a) * rest


def _ppf_middle(p: np.ndarray, k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Newton's steps on the expansion, from Wilson and Hilferty's start."""
    a, y = k / 2, x / 2
    for _ in range(6):
        eta = _eta(a, y)
        # The density at y: its ln gamma is left to Stirling's series.
        gamma = 1 / (12 * a) - 1 / (360 * a**3) + 1 / (1260 * a**5)
        density = np.exp(-a * eta * eta / 2 - gamma) * np.sqrt(a / (2 * math.pi)) / y
        step = (gamma_q_middle_np(a, y) - (1 - p)) / density
        y = y + step
        if (np.abs(step) <= 1e-15 * y).all():
            break
    return 2 * y


def chi2_ppf_np(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Quantile by Newton's steps on Temme's expansion where that holds, else by bisection on the survival function, from a Wilson-Hilferty bracket."""
    p, k = np.broadcast_arrays(np.asarray(p, float), np.asarray(k, float))
    z = norm_ppf_np(np.clip(p, 1e-300, 1 - 1e-16)) if p.size == 0 or (p != p.flat[0]).any() else np.full(p.shape, norm_ppf_np(np.clip(p.ravel()[:1], 1e-300, 1 - 1e-16))[0])
    guess = k * np.maximum(1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k)), 1e-3) ** 3
    # Close to the edges of p a step's error is too large beside what is left of p.
    middle = (k >= 2 * TEMME_A) & (p > 1e-6) & (p < 1 - 1e-6)
    middle[middle] = np.abs(_eta(k[middle] / 2, guess[middle] / 2)) < TEMME_ETA
    out = np.empty(guess.shape)
    if middle.any():
        out[middle] = _ppf_middle(p[middle], k[middle], guess[middle])
    if not middle.all():
        out[~middle] = _ppf_bisected(p[~middle], k[~middle], guess[~middle])
    return out


def _ppf_bisected(p: np.ndarray, k: np.ndarray, guess: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros_like(guess), np.maximum(guess, k) * 2 + 20
    while True:
        short = gamma_q_np(k / 2, hi / 2) > 1 - p
        if not short.any():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = gamma_q_np(k / 2, mid / 2) > 1 - p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(p == 0, 0.0, np.where(p == 1, np.inf, (lo + hi) / 2))


@F.pandas_udf(DoubleType())
def ln_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def gamma_q(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(gamma_q_np(a.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return pd.Series(_erfc(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf_np(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf_np(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(gamma_q_np(k.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(DoubleType())
def chi2_ppf(p: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_ppf_np(p.to_numpy(float), k.to_numpy(float)))


def gamma_p(a: Column, x: Column) -> Column:
    return 1 - gamma_q(a, x)


def norm_cdf(z: Column) -> Column:
    return norm_sf(-z)


def normal_p(z: Column, tail: str = "two") -> Column:
    """Normal p-value (two, upper or lower tail), not under 1e-300."""
    p = {"two": 2 * norm_sf(F.abs(z)), "upper": norm_sf(z), "lower": norm_sf(-z)}[tail]
    return F.greatest(p, F.lit(P_FLOOR))


def chi_square_p(x: Column, df: Column) -> Column:
    return F.greatest(chi2_sf(x.cast("double"), df.cast("double")), F.lit(P_FLOOR))


def chi2_sf_even(x: Column, df: Column) -> Column:
    """Upper chi-square tail for an even df in plain SQL: exp(-x/2) * sum of (x/2)**i / i!."""
    half = x / 2
    step = lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["total"] + acc["term"] * half / i).alias("total"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(df >= 4, F.sequence(F.lit(1), (df / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exp(-half) * F.aggregate(steps, start, step)["total"]


def chi2_cdf(x: Column, df: Column) -> Column:
    return gamma_p(df.cast("double") / 2, x.cast("double") / 2)
