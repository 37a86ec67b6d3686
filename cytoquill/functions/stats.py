"""Numbers: RMS, safe division, exact confidence limits."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(value: Column) -> Column:
    """Root mean square; missing values take no part."""
    v = value.cast("double")
    return F.sqrt(F.avg(v * v))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


#: Steps after which a series counts as not converging.
MOST_STEPS = 1_000_000
#: From this shape on, gamma quantiles come from their expansion around the normal ones.
LARGE_SHAPE = 10_000.0


def gamma_quantile_large(p: float, shape: np.ndarray) -> np.ndarray:
    """Quantile of a gamma variable of large shape (Cornish-Fisher expansion; the next term is below 1e-6)."""
    z = NormalDist().inv_cdf(p)
    root = np.sqrt(shape)
    return shape + z * root + (z * z - 1) / 3 + (z**3 - 7 * z) / (36 * root) - (3 * z**4 + 7 * z * z - 16) / (810 * shape)


def _beta_continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, MOST_STEPS):
        m2 = 2 * m
        for num in (m * (b - m) * x / ((a - 1 + m2) * (a + m2)), -(a + m) * (a + b + m) * x / ((a + m2) * (a + 1 + m2))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
        if np.all(np.abs(step - 1.0) < 1e-14):
            return h
    raise ArithmeticError("the continued fraction of the beta function did not converge")


_lgamma = np.vectorize(lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, vectorised."""
    x, a, b = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (x, a, b))
    x, a, b = np.broadcast_arrays(x, a, b)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    flip = inside > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
    part = front * _beta_continued_fraction(aa, bb, xx) / aa
    out = np.where(flip, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, vectorised: series below, continued fraction above."""
    x, a = np.broadcast_arrays(np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(shape, float)))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    term = 1.0 / a
    series = term.copy()
    n = a.copy()
    for _ in range(MOST_STEPS):
        n = n + 1
        term = term * safe / n
        series = series + term
        if np.all((np.abs(term) < np.abs(series) * 1e-15) | (safe >= a + 1)):
            break
    else:
        raise ArithmeticError("the series of the gamma function did not converge")
    tiny = 1e-300
    b = safe + 1 - a
    c = np.full_like(b, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, MOST_STEPS):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-14) | (safe < a + 1)):
            break
    else:
        raise ArithmeticError("the continued fraction of the gamma function did not converge")
    return np.where(x <= 0, 0.0, np.where(safe < a + 1, front * series, 1 - front * h))


def _bisect(cdf, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    low, high = low.astype(float).copy(), high.astype(float).copy()
    for _ in range(90):
        mid = (low + high) / 2
        below = cdf(mid) < target
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def binomial_limits(hits: np.ndarray, trials: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact (Clopper-Pearson) limits of a proportion."""
    k, n = np.asarray(hits, float), np.asarray(trials, float)
    tail = np.full(k.shape, (1 - level) / 2)
    zero, one = np.zeros_like(k), np.ones_like(k)
    lower = _bisect(lambda p: beta_cdf(p, np.maximum(k, 1), n - k + 1), tail, zero, one)
    upper = _bisect(lambda p: beta_cdf(p, k + 1, np.maximum(n - k, 1)), 1 - tail, zero, one)
    return np.where(k <= 0, 0.0, lower), np.where(k >= n, 1.0, upper)


def poisson_limits(count: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact limits of a Poisson mean."""
    every = np.asarray(count, float)
    large = every >= LARGE_SHAPE
    k = np.where(large, 0.0, every)
    tail = np.full(k.shape, (1 - level) / 2)
    top = (k + 10) * 3 + 10 * np.sqrt(k + 1)
    lower = _bisect(lambda m: gamma_cdf(m, np.maximum(k, 1)), tail, np.zeros_like(k), top)
    upper = _bisect(lambda m: gamma_cdf(m, k + 1), 1 - tail, np.zeros_like(k), top)
    lower = np.where(k <= 0, 0.0, lower)
    safe = np.where(large, every, LARGE_SHAPE)
    outer = (1 - level) / 2
    return np.where(large, gamma_quantile_large(outer, safe), lower), np.where(large, gamma_quantile_large(1 - outer, safe + 1), upper)


def binomial_upper_tail(hits: np.ndarray, trials: np.ndarray, rate: float) -> np.ndarray:
    """P(X >= hits) for X ~ Binomial(trials, rate)."""
    k, n = np.asarray(hits, float), np.asarray(trials, float)
    p = beta_cdf(np.full(k.shape, rate), np.maximum(k, 1), np.maximum(n - k + 1, 1))
    return np.where(k <= 0, 1.0, p)


def with_binomial_limits(df, hits: str, trials: str, level: float, prefix: str = ""):
    """Add `{prefix}lower_ci` and `{prefix}upper_ci`; zero where there are no trials."""

    @F.pandas_udf("lower double, upper double")
    def limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = binomial_limits(k.to_numpy(), np.maximum(n.to_numpy(), 1), level)
        none = n.to_numpy() <= 0
        return pd.DataFrame({"lower": np.where(none, 0.0, low), "upper": np.where(none, 0.0, high)})

    out = df.withColumn("_ci", limits(F.col(hits).cast("double"), F.col(trials).cast("double")))
    return out.withColumns({f"{prefix}lower_ci": F.col("_ci.lower"), f"{prefix}upper_ci": F.col("_ci.upper")}).drop("_ci")


def with_poisson_rates(df, hits: str, bases: str, level: float = 0.95):
    """Add `rate`, `rate_lo` and `rate_hi` per base; NULL where no base was covered."""

    @F.pandas_udf("lower double, upper double")
    def limits(k: pd.Series) -> pd.DataFrame:
        low, high = poisson_limits(k.to_numpy(), level)
        return pd.DataFrame({"lower": low, "upper": high})

    n = F.nullif(F.col(bases).cast("double"), F.lit(0.0))
    return (
        df.withColumn("_ci", limits(F.col(hits).cast("double")))
        .withColumns({"rate": F.col(hits) / n, "rate_lo": F.col("_ci.lower") / n, "rate_hi": F.col("_ci.upper") / n})
        .drop("_ci")
    )
