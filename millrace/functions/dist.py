"""Distribution functions, used on results that are already a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _bisect(f, lo: float, hi: float, target: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    return _bisect(norm_cdf, -40, 40, p) if p <= 0.5 else -_bisect(norm_cdf, -40, 40, 1 - p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_ppf(p: float, df: float) -> float:
    return _bisect(lambda t: 1 - t_sf(t, df), -1e4, 1e4, p)


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_i(a, b, x), 0.0, 1.0, p)


def kolmogorov_sf(x: float) -> float:
    return 1.0 if x <= 0 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def apply(fn, *columns: Column) -> Column:
    """A function of doubles over the rows of a small result; NULL or NaN in, NULL out."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        def one(*v):
            if any(x is None or x != x for x in v):
                return None
            out = fn(*map(float, v))
            return None if out != out else out

        return pd.Series([one(*v) for v in zip(*cols, strict=True)], dtype="float64")

    return run(*(c.cast("double") for c in columns))


def two_sided_t(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    pick = {"two-sided": lambda x, d: 2 * t_sf(abs(x), d), "greater": t_sf, "less": lambda x, d: 1 - t_sf(x, d)}[alternative]
    return apply(pick, t, df)


def p_normal(z: Column, alternative: str = "two-sided") -> Column:
    pick = {"two-sided": lambda x: 2 * norm_cdf(-abs(x)), "greater": lambda x: norm_cdf(-x), "less": norm_cdf}[alternative]
    return apply(pick, z)
