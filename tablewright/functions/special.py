"""Distribution functions that Spark SQL lacks, as vectorised pandas functions over numpy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _over(f):
    """Applies f to distinct argument tuples of a batch only."""

    def run(*cols: pd.Series) -> pd.Series:
        table = pd.DataFrame({k: c.astype(float) for k, c in enumerate(cols)})
        known = table.drop_duplicates()
        known = known.assign(out=[f(*row) if not any(map(math.isnan, row)) else math.nan for row in known.itertuples(index=False, name=None)])
        return table.merge(known, how="left", on=list(range(len(cols))))["out"]

    return run


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def gammaq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
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
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_tail(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gammaq(df / 2, x / 2)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def _udf(f, n: int):
    run = _over(f)
    shapes = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    g = shapes[n]
    g.__annotations__ = {k: pd.Series for k in ("a", "b", "c")[:n]} | {"return": pd.Series}
    return F.pandas_udf(g, "double")


def t_p(t, df):
    """Two-sided p of Student's t."""
    return _udf(t_two_sided, 2)(t, df)


def f_p(x, d1, d2):
    """Upper tail of F."""
    return _udf(f_tail, 3)(x, d1, d2)


def chi2_p(x, df):
    """Upper tail of chi-square."""
    return _udf(chi2_tail, 2)(x, df)


def cdf(x):
    """Standard normal distribution."""
    return _udf(normal_cdf, 1)(x)


def inverse_cdf(p):
    """Standard normal quantile."""
    return _udf(normal_inverse, 1)(p)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]
