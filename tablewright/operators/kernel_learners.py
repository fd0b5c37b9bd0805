"""Kernel machines and relevance vector machines.

They learn from at most `sample` complete rows, chosen by hash in equal parts for each class (a documented bound: a kernel has the
square of that many entries), and score all rows in batches where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def kernel(name: str, gamma: float = 0.5, degree: int = 3, shift: float = 0.0) -> Kernel:
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if name == "rbf":
            return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
        dot = a @ b.T
        return {"linear": lambda: dot, "poly": lambda: (gamma * dot + shift) ** degree, "sigmoid": lambda: np.tanh(gamma * dot + shift)}[name]()

    return k


def solve_dual(q: np.ndarray, p: np.ndarray, y: np.ndarray, top: np.ndarray, start: np.ndarray, tol: float = 1e-3, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """Least of a'qa / 2 + p'a with 0 <= a <= top and y'a as at the start, and the offset b, by steps in the pair that violates most."""
    a, g = start.astype(float).copy(), q @ start + p
    diag = np.diag(q)
    for _ in range(rounds):
        up, low = np.where(y > 0, a < top, a > 0), np.where(y > 0, a > 0, a < top)
        f = -y * g
        i = int(np.argmax(np.where(up, f, -np.inf)))
        gap = f[i] - f
        if not up.any() or not low.any() or (gap[low] < tol).all():
            break
        bend = np.maximum(diag[i] + diag - 2 * y[i] * y * q[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / bend, -np.inf)))
        step = gap[j] / bend[j]
        step = min(step, top[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top[j] - a[j])
        di, dj = y[i] * step, -y[j] * step
        a[i], a[j] = np.clip(a[i] + di, 0, top[i]), np.clip(a[j] + dj, 0, top[j])
        g += di * q[i] + dj * q[j]
    f, free = -y * g, (a > 1e-9 * top) & (a < top * (1 - 1e-9))
    if free.any():
        return a, float(f[free].mean())
    up, low = np.where(y > 0, a < top, a > 0), np.where(y > 0, a > 0, a < top)
    ends = [e for e in ((f[up].max() if up.any() else None), (f[low].min() if low.any() else None)) if e is not None]
    return a, float(np.mean(ends))


def support_classifier(x: np.ndarray, y: np.ndarray, k: Kernel, cost: float = 1.0, weights: tuple[float, float] = (1.0, 1.0)):
    """Soft-margin machine; y is 1 or -1, weights (negative, positive) scale the cost."""
    top = cost * np.where(y > 0, weights[1], weights[0]).astype(float)
    a, b = solve_dual(np.outer(y, y) * k(x, x), -np.ones(len(x)), y, top, np.zeros(len(x)))
    s = a > 0
    return lambda z: k(z, x[s]) @ (a * y)[s] + b


def support_regressor(x: np.ndarray, y: np.ndarray, k: Kernel, cost: float = 1.0, width: float = 0.1):
    """Errors up to `width` are free."""
    n, g = len(x), k(x, x)
    sign = np.r_[np.ones(n), -np.ones(n)]
    a, b = solve_dual(np.outer(sign, sign) * np.tile(g, (2, 2)), np.r_[width - y, width + y], sign, np.full(2 * n, cost), np.zeros(2 * n))
    c = a[:n] - a[n:]
    s = c != 0
    return lambda z: k(z, x[s]) @ c[s] + b


def one_class(x: np.ndarray, k: Kernel, nu: float = 0.1):
    """Positive inside the region that holds some 1 - nu of the rows."""
    n = len(x)
    start = np.clip(nu * n - np.arange(n), 0, 1)
    a, b = solve_dual(k(x, x), np.zeros(n), np.ones(n), np.ones(n), start)
    s = a > 0
    return lambda z: k(z, x[s]) @ a[s] + b


def _prune(alpha: np.ndarray) -> np.ndarray:
    keep = alpha < 1e9
    return keep if keep.any() else alpha == alpha.min()


def relevance_regressor(x: np.ndarray, y: np.ndarray, k: Kernel, rounds: int = 300):
    """Sparse Bayesian regression on a kernel at the rows and an offset; precisions by evidence."""
    phi = np.column_stack([np.ones(len(x)), k(x, x)])
    at, alpha, beta, m = np.arange(phi.shape[1]), np.ones(phi.shape[1]), 10 / max(y.var(), 1e-12), None
    for _ in range(rounds):
        p = phi[:, at]
        s = np.linalg.pinv(np.diag(alpha) + beta * p.T @ p, hermitian=True)
        m = beta * s @ p.T @ y
        g = np.clip(1 - alpha * np.diag(s), 1e-12, 1)
        new = np.minimum(g / np.maximum(m * m, 1e-24), 1e12)
        beta = max(len(y) - g.sum(), 1e-3) / max(((y - p @ m) ** 2).sum(), 1e-12)
        done = np.abs(np.log(new) - np.log(alpha)).max() < 1e-3
        keep = _prune(new)
        at, alpha, m = at[keep], new[keep], m[keep]
        if done:
            break
    return _basis(x, k, at, m)


def _basis(x: np.ndarray, k: Kernel, at: np.ndarray, m: np.ndarray):
    offset, rows = float(m[at == 0].sum()), at[at > 0] - 1
    w = m[at > 0]

    def f(z: np.ndarray) -> np.ndarray:
        return k(z, x[rows]) @ w + offset if len(rows) else np.full(len(z), offset)

    f.kept = len(at)
    return f


def relevance_classifier(x: np.ndarray, y: np.ndarray, k: Kernel, rounds: int = 100):
    """Sparse Bayesian logistic model (y 1 or -1) around the most likely weights; gives log odds."""
    t, phi = (y > 0).astype(float), np.column_stack([np.ones(len(x)), k(x, x)])
    at, alpha, m = np.arange(phi.shape[1]), np.full(phi.shape[1], 1e-2), np.zeros(phi.shape[1])
    for _ in range(rounds):
        p = phi[:, at]
        loss = lambda w, p=p, alpha=alpha: np.logaddexp(0, p @ w).sum() - t @ (p @ w) + (alpha * w * w).sum() / 2
        for _ in range(25):
            e = 1 / (1 + np.exp(-np.clip(p @ m, -500, 500)))
            h = (p.T * (e * (1 - e))) @ p + np.diag(alpha)
            step, size, now = np.linalg.solve(h, p.T @ (t - e) - alpha * m), 1.0, loss(m)
            while loss(m + size * step) > now and size > 1e-6:
                size /= 2
            m = m + size * step
            if np.abs(size * step).max() < 1e-6:
                break
        g = np.clip(1 - alpha * np.diag(np.linalg.inv(h)), 1e-12, 1)
        new = np.minimum(g / np.maximum(m * m, 1e-24), 1e12)
        done = np.abs(np.log(new) - np.log(alpha)).max() < 1e-3
        keep = _prune(new)
        at, alpha, m = at[keep], new[keep], m[keep]
        if done:
            break
    return _basis(x, k, at, m)


LEARNERS: dict[str, tuple[bool, Callable]] = {
    "support_classifier": (True, support_classifier), "relevance_classifier": (True, relevance_classifier), "support_regressor": (False, support_regressor), "relevance_regressor": (False, relevance_regressor), "one_class": (False, lambda x, y, k, **s: one_class(x, k, **s)),
}


def fit(name: str, df: DataFrame, features: Sequence[str], label: str | None, kernel_name: str = "rbf", sample: int = 1000, seed: int = 0, kernel_settings: dict | None = None, **settings):
    """A function of a DataFrame that adds `score` (and `prediction`, the label of the sign, where there are two).

    Columns are standardised on the sample. Rows with a missing feature get none. Classification wants two labels; the larger is positive.
    """
    cols, two = list(features), LEARNERS[name][0]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols), *([F.col(label).alias("_y")] if label else [F.lit(0.0).alias("_y")])).dropna()
    order = [F.xxhash64(F.lit(seed), *cols), *cols]
    if two:
        labels = sorted(r[0] for r in rows.select("_y").distinct().limit(3).collect())
        if len(labels) != 2:
            raise ValueError(f"two labels wanted, not {labels}")
        parts = [rows.filter(F.col("_y") == v).orderBy(*order).limit(sample // 2) for v in labels]
        rows = parts[0].unionByName(parts[1])
    else:
        labels = []
        rows = rows.orderBy(*order).limit(sample)
    got = rows.collect()
    if not got:
        raise ValueError("no complete rows to learn from")
    x = np.array([r[:-1] for r in got], float)
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    y = np.array([1.0 if r[-1] == labels[1] else -1.0 for r in got]) if two else np.array([float(r[-1]) for r in got])
    scores = LEARNERS[name][1]((x - mean) / sd, y, kernel(kernel_name, **(kernel_settings or {})), **settings)

    def score(*parts: pd.Series) -> pd.Series:
        z = (np.column_stack([p.to_numpy(float) for p in parts]) - mean) / sd
        out = np.full(len(z), np.nan)
        full = np.flatnonzero(~np.isnan(z).any(1))
        for lo in range(0, len(full), 4096):
            out[full[lo : lo + 4096]] = scores(z[full[lo : lo + 4096]])
        return pd.Series([None if np.isnan(v) else v for v in out], dtype=object)

    given = F.pandas_udf(score, "double")

    def apply(d: DataFrame) -> DataFrame:
        out = d.withColumn("score", given(*(F.col(c).cast("double") for c in cols)))
        return out.withColumn("prediction", F.when(F.col("score") >= 0, F.lit(labels[1])).when(F.col("score").isNotNull(), F.lit(labels[0]))) if two else out

    return apply
