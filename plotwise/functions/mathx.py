"""Numeric column expressions, and the few distribution tails the driver needs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (Acklam).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
# Erfc rational approximation (Numerical Recipes, relative error < 1.2e-7).
_E = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
      -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal CDF of a probability column, |relative error| < 1.2e-9."""
    q = F.sqrt(F.lit(-2.0) * F.ln(F.when(p < 0.5, p).otherwise(1 - p)))
    tail = _horner(_C, q) / _horner(_D + [1.0], q)
    r = (p - 0.5) * (p - 0.5)
    mid = (p - 0.5) * _horner(_A, r) / _horner(_B + [1.0], r)
    inner = (p >= 0.02425) & (p <= 1 - 0.02425)
    return F.when(inner, mid).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF as a column, error < 1.2e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (1 + x * 0.5)
    erfc = t * F.exp(-x * x + _horner(list(reversed(_E)), t))
    return F.when(z >= 0, 1 - erfc / 2).otherwise(erfc / 2)


# -------------------------------------------------------------- driver side


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Upper regularized incomplete gamma."""
    if x <= 0:
        return 1.0
    pre = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - pre * total
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return pre * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    if not f > 0 or d2 <= 0:
        return 1.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided t tail."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_sf(x: float) -> float:
    if x <= 0.04:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5 by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_sf2(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
