"""Filters on volumes: each case is a row whose array column holds the voxels of a box, x fastest, or those of a mask inside it.

A case is filtered where its row lies, a batch at a time, so nothing is exchanged; a row's memory is some eight boxes. Voxels outside
the mask count as 0. A null array stays null, a missing voxel stays missing and counts as 0 for its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: B3-spline taps of the undecimated transform.
TAPS = np.array([1, 4, 6, 4, 1]) / 16


def _shift(v: np.ndarray, axis: int, by: int, border: str) -> np.ndarray:
    """Values `by` places further along an axis; beyond the box the edge again, its mirror image, or 0."""
    n = v.shape[axis]
    at = np.arange(n) + by
    if border == "mirror" and n > 1:
        at = np.abs((at + (n - 1)) % (2 * (n - 1)) - (n - 1))
    out = np.take(v, np.clip(at, 0, n - 1), axis)
    if border == "zero":
        shape = [1] * v.ndim
        shape[axis] = n
        out = out * ((at >= 0) & (at < n)).reshape(shape)
    return out


def differences6(v: np.ndarray) -> np.ndarray:
    """Sum of absolute differences from the six neighbours."""
    return sum(np.abs(_shift(v, a, s, "edge") - v) for a in (1, 2, 3) for s in (-1, 1))


def _along(v: np.ndarray, f: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    for axis in (1, 2, 3):
        v = f(v, axis)
    return v


def variance27(v: np.ndarray) -> np.ndarray:
    """Population variance of the cube of 27 around each voxel, the edge repeated; taken about the voxel itself."""
    offsets = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    s, q = np.zeros_like(v), np.zeros_like(v)
    for x, y, z in offsets:
        d = _shift(_shift(_shift(v, 3, x, "edge"), 2, y, "edge"), 1, z, "edge") - v
        s += d
        q += d * d
    return np.maximum(q / 27 - (s / 27) ** 2, 0)


def gaussian(v: np.ndarray, fwhm: float, voxel: Sequence[float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Separable Gaussian of a full width at half maximum in the unit of `voxel` (x, y, z); 0 beyond the box, kernel of sum one."""
    if fwhm <= 0:
        return v

    def one(u: np.ndarray, axis: int) -> np.ndarray:
        sigma = fwhm / np.sqrt(8 * np.log(2)) / voxel[3 - axis]
        reach = int(np.ceil(4 * sigma))
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        return sum(k * _shift(u, axis, i, "zero") for i, k in zip(range(-reach, reach + 1), w / w.sum(), strict=True))

    return _along(v, one)


def wavelet(v: np.ndarray, level: int, keep: str = "approximation", border: str = "mirror", factor: float = 3.0) -> np.ndarray:
    """Undecimated transform by B3 splines with holes: the approximation of a level, or all put together with details denoised.

    soft and hard cut each level's details at `factor` times their spread, the median of absolute values over 0.6745, for each case.
    """
    out, now = np.zeros_like(v), v
    for i in range(level):
        low = _along(now, lambda u, axis, i=i: sum(k * _shift(u, axis, j * 2**i, border) for j, k in zip(range(-2, 3), TAPS, strict=True)))
        detail = now - low
        cut = factor * np.median(np.abs(detail), axis=(1, 2, 3), keepdims=True) / 0.6745
        out += np.sign(detail) * np.maximum(np.abs(detail) - cut, 0) if keep == "soft" else detail * (np.abs(detail) > cut)
        now = low
    return now if keep == "approximation" else out + now


def clusters(v: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    """1 + the smallest place of each voxel's cluster of face neighbours above a threshold; 0 elsewhere."""
    on = v > threshold
    place = np.broadcast_to(np.arange(1, v[0].size + 1, dtype=float).reshape(v[0].shape), v.shape)
    label = np.where(on, place, 0.0)
    while True:
        new = label
        for axis in (1, 2, 3):
            for s in (-1, 1):
                other = _shift(new, axis, s, "zero")
                new = np.where(on & (other > 0), np.minimum(new, other), new)
        if (new == label).all():
            return label
        label = new


def consistency(v: np.ndarray) -> np.ndarray:
    """Differences from the six neighbours as a share of the case's largest; 0 where all are 0."""
    c = differences6(v)
    top = c.max(axis=(1, 2, 3), keepdims=True)
    return c / np.where(top > 0, top, 1)


def _divided(by: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    def f(v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            x = v / by(v)
        return np.where(np.isfinite(x), x, np.nan)

    return f


def _log_share(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        c = np.log(variance27(v))
    return c / c.max(axis=(1, 2, 3), keepdims=True)


FILTERS: dict[str, Callable] = {"differences6": differences6, "variance27": variance27, "gaussian": gaussian, "wavelet": wavelet, "clusters": clusters, "consistency": consistency, "over_differences6": _divided(differences6), "over_variance27": _divided(_log_share)}


def filter_volumes(df: DataFrame, column: str, dims: Sequence[int], how: str, inside: Sequence[int] | None = None, **settings) -> DataFrame:
    """Rows with the filtered array in place. dims: x, y, z; inside: the flat places of the array's voxels if they are not the whole box.

    over_differences6 and over_variance27 divide the voxels by the map (the latter its logarithm over the case's largest); where that is not defined
    the voxel is missing. An array of another length than the mask is an error.
    """
    nx, ny, nz = dims
    at = np.arange(nx * ny * nz) if inside is None else np.asarray(inside)
    run = FILTERS[how]

    def one(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        rows = np.flatnonzero(s.notna().to_numpy())
        step = max(1, (1 << 22) // (nx * ny * nz))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            x = np.stack([np.asarray(s.iloc[i], float) for i in some])
            if x.shape[1] != len(at):
                raise ValueError(f"{x.shape[1]} voxels, the mask has {len(at)}")
            gap = np.isnan(x)
            box = np.zeros((len(x), nx * ny * nz))
            box[:, at] = np.where(gap, 0, x)
            got = run(box.reshape(len(x), nz, ny, nx), **settings).reshape(len(x), -1)[:, at]
            got = np.where(gap, np.nan, got)
            for i, g in zip(some, got, strict=True):
                out.iloc[i] = [None if np.isnan(e) else float(e) for e in g]
        return out

    return df.withColumn(column, F.pandas_udf(one, "array<double>")(F.col(column).cast("array<double>")))
