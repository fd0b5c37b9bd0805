"""Dimensionality reduction: a linear map (or a kernel one on landmarks) learnt from moments or a bounded sample, applied as arrays.

PCA (probabilistic, too), LDA and PLS need only first and second moments, which one pass sums; NMF and fast ICA sum small products over all rows in
each pass. LPP and kernel PCA learn from at most `sample` rows chosen by hash, a documented bound, and project all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .moment_forms import probabilistic_map
from .numeric import moments


def _sign(w: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])


def _generalised(a: np.ndarray, b: np.ndarray, k: int, largest: bool = True) -> np.ndarray:
    val, vec = np.linalg.eig(np.linalg.solve(b + 1e-9 * np.trace(b) / len(b) * np.eye(len(b)), a))
    order = np.argsort(val.real)
    return vec.real[:, order[::-1][:k] if largest else order[:k]]


def pca_map(m: dict, k: int) -> np.ndarray:
    val, vec = np.linalg.eigh(m["cov"])
    return vec[:, np.argsort(val)[::-1][:k]]


def lda_map(by_class: list[dict], k: int) -> np.ndarray:
    n = sum(c["n"] for c in by_class)
    mean = sum(c["n"] * c["mean"] for c in by_class) / n
    within = sum((c["n"] - 1) * c["cov"] for c in by_class) / n
    between = sum(c["n"] * np.outer(c["mean"] - mean, c["mean"] - mean) for c in by_class) / n
    return _generalised(between, within, k)


def pls_map(m: dict, k: int) -> np.ndarray:
    """Weights of a PLS on one outcome, the last of the moments' columns, by deflating covariances."""
    c, y = m["cov"][:-1, :-1].copy(), m["cov"][:-1, -1].copy()
    out = []
    for _ in range(k):
        w = y / max(np.linalg.norm(y), 1e-300)
        t2 = w @ c @ w
        load = c @ w / max(t2, 1e-300)
        out.append(w)
        y = y - load * (w @ y)
        c = c - np.outer(load, load) * t2
    return np.column_stack(out)


def _sums(rows: DataFrame, cols: Sequence[str], f) -> np.ndarray:
    """The sum of f(rows as an array) over all rows; f gives a vector of fixed size."""

    def each(batches):
        total = sum((f(p[cols].to_numpy(float)) for p in batches if len(p)), np.zeros(1))
        yield pd.DataFrame({"s": [np.atleast_1d(total).tolist()]})

    parts = [np.array(r[0]) for r in rows.select(*cols).mapInPandas(each, "s array<double>").collect()]
    return sum((x for x in parts if len(x) > 1 or x[0]), np.zeros(1))


def nmf(rows: DataFrame, cols: Sequence[str], mean: np.ndarray, sd: np.ndarray, k: int, rounds: int = 100, inner: int = 20, seed: int = 0) -> np.ndarray:
    """Basis (k x columns) of all rows, standardised and shifted to be non-negative, by multiplicative updates.

    In a round each task solves for its own rows' weights from the same start; only their products with the rows and with themselves are summed.
    """
    low = np.array(rows.agg(*(F.min(c) for c in cols)).first(), float)
    h = np.random.default_rng(seed).random((k, len(cols))) + 0.1
    for _ in range(rounds):

        def products(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            x = (x - low) / sd
            w = np.full((len(x), k), 0.5)
            for _ in range(inner):
                w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
            return np.r_[(w.T @ x).ravel(), (w.T @ w).ravel()]

        s = _sums(rows, cols, products)
        wx, ww = s[: h.size].reshape(h.shape), s[h.size :].reshape(k, k)
        new = h.copy()
        for _ in range(inner):
            new *= wx / (ww @ new + 1e-12)
        done = np.abs(new - h).max() < 1e-6 * np.abs(h).max()
        h = new
        if done:
            break
    return h


def fast_ica(rows: DataFrame, cols: Sequence[str], mean: np.ndarray, sd: np.ndarray, c: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Fixed-point passes over all rows, whitened by their covariance c; a pass sums k x k products."""
    val, vec = np.linalg.eigh(c)
    white = vec[:, ::-1][:, :k] / np.sqrt(np.maximum(val[::-1][:k], 1e-12))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):

        def products(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) / sd @ white
            g = np.tanh(z @ w)
            return np.r_[len(x), (z.T @ g).ravel(), (1 - g**2).sum(0)]

        s = _sums(rows, cols, products)
        u, _, v = np.linalg.svd(s[1 : 1 + k * k].reshape(k, k) / s[0] - w * s[1 + k * k :] / s[0])
        new = u @ v
        done = np.abs(np.abs((new * w).sum(0)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return white @ w


def lpp(x: np.ndarray, k: int, near: int = 10) -> np.ndarray:
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    a = np.zeros_like(d)
    at = np.argsort(d, axis=1)[:, 1 : near + 1]
    s = np.median(d[np.arange(len(x))[:, None], at]) + 1e-12
    a[np.arange(len(x))[:, None], at] = np.exp(-d[np.arange(len(x))[:, None], at] / s)
    a = np.maximum(a, a.T)
    g = np.diag(a.sum(1))
    return _generalised(x.T @ (g - a) @ x, x.T @ g @ x, k, largest=False)


def reduce(df: DataFrame, columns: Sequence[str], label: str, method: str, k: int, sample: int = 800, seed: int = 0) -> DataFrame:
    """Adds z1..zk to the rows. Columns are standardised first; rows with a missing value get missing components."""
    m = moments(df, columns)[0]
    mean, sd = m["mean"], np.sqrt(np.maximum(np.diag(m["cov"]), 1e-12))
    m = {"n": m["n"], "mean": np.zeros(len(columns)), "cov": m["cov"] / np.outer(sd, sd)}
    if method in ("pca", "lda", "pls", "ppca"):
        if method == "pca":
            w = pca_map(m, k)
        elif method == "ppca":
            w = probabilistic_map(m, k)[0]
        elif method == "lda":
            w = lda_map([{"n": c["n"], "mean": (c["mean"] - mean) / sd, "cov": c["cov"] / np.outer(sd, sd)} for c in moments(df, columns, [label])], k)
        else:
            both = moments(df, [*columns, label])[0]
            s = np.append(sd, 1.0)
            w = pls_map({"cov": both["cov"] / np.outer(s, s)}, k)
        w = _sign(w)
    elif method in ("nmf", "fast_ica"):
        rows = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna(), "complete-rows")
        w = np.linalg.pinv(nmf(rows, list(columns), mean, sd, k, seed=seed)) if method == "nmf" else _sign(fast_ica(rows, list(columns), mean, sd, m["cov"], k, seed=seed))
    else:
        rows = df.select(*columns).dropna().orderBy(F.xxhash64(F.lit(seed), *columns)).limit(sample).collect()
        x = (np.array(rows, float) - mean) / sd
        if method == "kernel_pca":
            return _kernel_pca(df, columns, x, mean, sd, k)
        w = _sign({"lpp": lpp}[method](x, k))
    z = {f"z{j + 1}": sum((F.col(c) - float(mean[i])) * float(w[i, j] / sd[i]) for i, c in enumerate(columns)) for j in range(w.shape[1])}
    return df.withColumns(z)


def _kernel_pca(df: DataFrame, columns: Sequence[str], x: np.ndarray, mean: np.ndarray, sd: np.ndarray, k: int) -> DataFrame:
    """Gaussian kernel PCA on landmark rows."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = np.median(d) + 1e-12
    kern = np.exp(-d / s)
    centre = np.eye(len(x)) - 1 / len(x)
    val, vec = np.linalg.eigh(centre @ kern @ centre)
    alpha = vec[:, ::-1][:, :k] / np.sqrt(np.maximum(val[::-1][:k], 1e-12))
    col_mean, all_mean, cols = kern.mean(0), kern.mean(), list(columns)

    def each(batches):
        for p in batches:
            v = (p[cols].to_numpy(float) - mean) / sd
            for lo in range(0, len(p), 4096):
                q = np.exp(-((v[lo : lo + 4096, None] - x[None]) ** 2).sum(-1) / s)
                z = (q - q.mean(1, keepdims=True) - col_mean + all_mean) @ alpha
                yield p.iloc[lo : lo + 4096].assign(**{f"z{j + 1}": z[:, j] for j in range(k)})

    return df.mapInPandas(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", z{j + 1} double" for j in range(k)))


def procrustes(reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rotation that brings other's columns onto reference's."""
    u, _, v = np.linalg.svd(other.T @ reference)
    return u @ v


def back_project(df: DataFrame, weights: np.ndarray, components: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Components to input space by a matrix of (inputs, components)."""
    return df.withColumns({n: sum(F.col(c) * float(weights[i, j]) for j, c in enumerate(components)) for i, n in enumerate(names)})


