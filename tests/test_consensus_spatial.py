"""Volume filters against loops over voxels; consensus operators on odd rows."""

import numpy as np
import pytest

from tablewright.operators import consensus as c
from tablewright.operators import spatial

DIMS = (3, 4, 2)
BOX = np.random.default_rng(1).normal(size=(2, 2, 4, 3))


def rows(spark, v):
    return spark.createDataFrame([(i, [float(e) for e in x.ravel()]) for i, x in enumerate(v)], "id long, v array<double>")


def run(spark, how, v=BOX, **settings):
    got = spatial.filter_volumes(rows(spark, v), "v", DIMS, how, **settings).orderBy("id").collect()
    return np.array([[np.nan if e is None else e for e in r.v] for r in got]).reshape(v.shape)


def at(v, z, y, x):
    return v[min(max(z, 0), 1), min(max(y, 0), 3), min(max(x, 0), 2)]


def test_cubes(spark):
    six, cube = np.zeros_like(BOX), np.zeros_like(BOX)
    for n, z, y, x in np.ndindex(BOX.shape):
        v = BOX[n]
        six[n, z, y, x] = sum(abs(at(v, z + a, y + b, x + d) - v[z, y, x]) for a, b, d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
        cube[n, z, y, x] = np.var([at(v, z + a, y + b, x + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)])
    assert np.allclose(run(spark, "differences6"), six) and np.allclose(run(spark, "variance27"), cube)
    share = np.log(cube) / np.log(cube).max(axis=(1, 2, 3), keepdims=True)
    assert np.allclose(run(spark, "over_variance27"), BOX / share)


def test_gaussian_is_a_sum_over_all_voxels(spark):
    sigma = np.array([1.5 / np.sqrt(8 * np.log(2)) / s for s in (0.5, 1.0, 2.0)])
    want = np.zeros_like(BOX)
    norm = np.prod([np.exp(-0.5 * (np.arange(-int(np.ceil(4 * s)), int(np.ceil(4 * s)) + 1) / s) ** 2).sum() for s in sigma])
    for n, z, y, x in np.ndindex(BOX.shape):
        for a, b, d in np.ndindex(BOX.shape[1:]):
            away = np.array([d - x, b - y, a - z])
            if (np.abs(away) <= np.ceil(4 * sigma)).all():
                want[n, z, y, x] += BOX[n, a, b, d] * np.exp(-0.5 * ((away / sigma) ** 2).sum()) / norm
    assert np.allclose(run(spark, "gaussian", fwhm=1.5, voxel=(0.5, 1.0, 2.0)), want)
    assert np.allclose(run(spark, "gaussian", fwhm=0), BOX)


def test_wavelet(spark):
    flat = np.full_like(BOX, 2.5)
    assert np.allclose(run(spark, "wavelet", flat, level=2), 2.5) and np.allclose(run(spark, "wavelet", level=0), BOX)
    for keep in ("soft", "hard"):
        assert np.allclose(run(spark, "wavelet", level=2, keep=keep, factor=0), BOX)
    low = run(spark, "wavelet", level=2)
    assert np.allclose(run(spark, "wavelet", level=2, keep="hard", factor=1e9), low)
    line = np.arange(1.0, 9).reshape(1, 1, 1, 8)
    got = spatial.wavelet(line, 1, border="mirror")[0, 0, 0]
    taps, mirror = spatial.TAPS, lambda i: -i if i < 0 else 14 - i if i > 7 else i
    assert np.allclose(got, [sum(t * line[0, 0, 0, mirror(i + j)] for j, t in zip(range(-2, 3), taps, strict=True)) for i in range(8)])


def test_clusters(spark):
    got = run(spark, "clusters", threshold=0.2)
    for v, label in zip(BOX, got, strict=True):
        seen = {}
        for start in np.ndindex(v.shape):
            if v[start] <= 0.2 or start in seen:
                continue
            todo, group = [start], {start}
            while todo:
                p = todo.pop()
                for axis in range(3):
                    for s in (-1, 1):
                        o = tuple(q + s * (i == axis) for i, q in enumerate(p))
                        if all(0 <= q < m for q, m in zip(o, v.shape, strict=True)) and v[o] > 0.2 and o not in group:
                            group.add(o)
                            todo.append(o)
            seen |= {p: 1 + min(int(np.ravel_multi_index(g, v.shape)) for g in group) for p in group}
        assert all(label[p] == seen.get(p, 0) for p in np.ndindex(v.shape))


def test_masks_gaps_and_odd_rows(spark):
    inside = [0, 1, 3, 7, 20]
    df = spark.createDataFrame([(0, [1.0, 2.0, None, 4.0, 5.0], "x"), (1, None, None), (2, [3.0] * 5, "y")], "id long, v array<double>, extra string")
    got = {r.id: r for r in spatial.filter_volumes(df, "v", DIMS, "differences6", inside).collect()}
    box = np.zeros(24)
    box[inside] = [1, 2, 0, 4, 5]
    want = spatial.differences6(box.reshape(1, 2, 4, 3)).ravel()[inside]
    assert got[1].v is None and got[0].v[2] is None and got[0].extra == "x"
    assert all(np.isclose(a, b) for a, b in zip(got[0].v, want, strict=True) if a is not None)
    assert spatial.filter_volumes(df.limit(0), "v", DIMS, "differences6", inside).count() == 0
    with pytest.raises(Exception, match="the mask has 24"):
        spatial.filter_volumes(df, "v", DIMS, "differences6").collect()


def test_agreement_steps_and_error(spark):
    df = spark.createDataFrame([(f, p, int(p < f)) for f in range(5) for p in range(4)], "f long, p long, c int")
    keep = lambda *a, **k: {r.f for r in c.agreement(df, "f", "c", *a, **k).collect() if r.keep}
    assert keep("threshold", 90, tolerance=20, least=2) == {3, 4} and keep("threshold", 100) == {4}
    assert keep("top", 2) == {3, 4} and keep("share", 50) == {2, 3, 4} and keep("above", 50) == {3, 4}
    with pytest.raises(Exception, match="fewer than 3 features"):
        keep("threshold", 90, tolerance=5, least=3)


def test_local_reference_odd_rows(spark):
    s = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (2.0, 9.0), (None, 5.0), (1.0, None)], "a double, y double")
    t = spark.createDataFrame([(0, 1.0, 5.0), (1, 1.0, None), (2, None, 1.0), (3, 50.0, 1.0), (4, 2.9, 7.0)], "id long, a double, y double")
    got = {r.id: r for r in c.local_reference(s, t, {"a": 1.0}, "y").collect()}
    assert got[0].y == pytest.approx(1 / np.std([2, 4, 9], ddof=1)) and got[0].n == 3
    assert got[1].y is None and got[2].y is None and got[3].y is None and got[3].n is None
    assert got[4].y == 0.0 and got[4].n == 1
    exact = {r.id: r for r in c.local_reference(s, t, {"a": 0.0}, "y", "partcorr").collect()}
    assert exact[0].y == pytest.approx(2.0) and exact[4].y is None
    with pytest.raises(ValueError, match="more than 1 different"):
        c.local_reference(s, t, {"a": 1.0}, "y", most=1)
