"""Probability functions Spark has no expression for.

All but the normal quantile run as vectorised pandas UDFs on aggregated frames.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.functions.columns import as_column


def _log_gamma(values: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series from 10 upwards."""
    x = np.asarray(values, float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        if not small.any():
            break
        shift[small] -= np.log(x[small])
        x[small] += 1.0
    inverse = 1.0 / (x * x)
    series = np.zeros_like(x)
    for term in (-691 / 360360, 1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series * inverse + term
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series / x


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral, evaluated forwards."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    active = np.ones(x.shape, dtype=bool)
    m = 0
    while active.any():
        if m == 100_000:
            raise ArithmeticError("incomplete beta integral does not converge")
        m += 1
        step = np.ones_like(x)
        for odd in (False, True):
            if odd:
                term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
            else:
                term = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = step * c * d
            value = np.where(active, value * c * d, value)
        active = active & (np.abs(step - 1.0) > 1e-14)
    return value


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b)."""
    a, b, x = np.broadcast_arrays(
        np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)
    )
    inside = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    y = np.where(flip, 1.0 - x, x)
    log_scale = (
        _log_gamma(p + q)
        - _log_gamma(p)
        - _log_gamma(q)
        + p * np.log(y)
        + q * np.log1p(-y)
    )
    part = np.exp(log_scale) * _beta_fraction(p, q, y) / p
    out[inside] = np.where(flip, 1.0 - part, part)
    return out


def beta_quantile(prob: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse of `regularised_beta` in x, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(60):
        mid = (low + high) / 2.0
        below = regularised_beta(a, b, mid) < prob
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2.0


def exact_lower(count: np.ndarray, total: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Lower exact binomial limit; 0 when nothing was counted."""
    count, total = np.asarray(count, float), np.asarray(total, float)
    limit = beta_quantile((1 - level) / 2, np.maximum(count, 1.0), total - count + 1.0)
    return np.where(count <= 0, 0.0, limit)


def exact_upper(count: np.ndarray, total: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Upper exact binomial limit; 1 when everything was counted."""
    count, total = np.asarray(count, float), np.asarray(total, float)
    limit = beta_quantile(1 - (1 - level) / 2, count + 1.0, np.maximum(total - count, 1.0))
    return np.where(count >= total, 1.0, limit)


@F.pandas_udf(T.DoubleType())
def binomial_lower(count: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(exact_lower(count.to_numpy(), total.to_numpy()))


@F.pandas_udf(T.DoubleType())
def binomial_upper(count: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(exact_upper(count.to_numpy(), total.to_numpy()))


def normal_quantiles(prob: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution; NaN outside of (0, 1).

    A rational first guess in sqrt(-2 ln p), good to 5e-4, then three Newton steps on
    the lower tail, which is found by the continued fraction or the series of the
    error function.
    """
    prob = np.asarray(prob, float)
    inside = (prob > 0.0) & (prob < 1.0)
    p = np.where(inside, np.minimum(prob, 1.0 - prob), 0.25)
    t = np.sqrt(-2.0 * np.log(p))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (
        1.0 + t * (1.432788 + t * (0.189269 + t * 0.001308))
    )
    for _ in range(3):
        x = x + (_upper_tail(x) - p) / (np.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi))
    return np.where(inside, np.where(prob < 0.5, -x, x), np.nan)


def _upper_tail(x: np.ndarray) -> np.ndarray:
    """P(Z > x) for x of about -0.1 and more."""
    density = np.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)
    small = np.minimum(x, 3.0)
    term = total = small
    for n in range(1, 60):
        term = term * small * small / (2 * n + 1)
        total = total + term
    series = 0.5 - total * np.exp(-0.5 * small * small) / math.sqrt(2.0 * math.pi)
    large = np.maximum(x, 2.0)
    fraction = large
    for n in range(100, 0, -1):
        fraction = large + n / fraction
    return np.where(x < 2.5, series, density / fraction)


#: Published rational approximation of the normal quantile, fixed values: centre, tails and
#: far tails, each the numerator and the denominator without its constant 1.
QUANTILE_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
QUANTILE_TAILS = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
QUANTILE_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def normal_quantile(prob: str | Column) -> Column:
    """`normal_quantiles` as a column expression; null outside of (0, 1)."""
    prob = as_column(prob).cast("double")
    away = prob - F.lit(0.5)

    def ratio(parts: tuple, x: Column) -> Column:
        top, bottom = parts
        return horner(top, x) / horner((1.0, *bottom), x)

    def horner(terms: tuple, x: Column) -> Column:
        out = F.lit(terms[-1])
        for term in reversed(terms[:-1]):
            out = out * x + F.lit(term)
        return out

    depth = F.sqrt(-F.ln(F.least(prob, F.lit(1.0) - prob)))
    tail = F.when(depth <= 5.0, ratio(QUANTILE_TAILS, depth - F.lit(1.6))).otherwise(
        ratio(QUANTILE_FAR, depth - F.lit(5.0))
    )
    centre = away * ratio(QUANTILE_CENTRE, F.lit(0.180625) - away * away)
    return F.when(F.abs(away) <= F.lit(0.425), centre).when(
        (prob > 0) & (prob < 1), F.signum(away) * tail
    )


@F.pandas_udf(T.DoubleType())
def chi2_upper_tail_1df(value: pd.Series) -> pd.Series:
    """P(X > value) for one degree of freedom."""
    return pd.Series(
        [math.erfc(math.sqrt(v / 2.0)) if v is not None and v >= 0 else math.nan for v in value]
    )
