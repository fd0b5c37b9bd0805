"""Duals against their optimality conditions, learners on rows whose answer is known."""

import numpy as np
import pytest

from tablewright.operators import kernel_learners as k

R = np.random.default_rng(5)


def objective(q, p, a):
    return a @ q @ a / 2 + p @ a


@pytest.mark.parametrize("name", ["linear", "rbf", "poly"])
def test_dual_is_optimal(name):
    x = R.normal(size=(40, 3))
    y = np.where(x[:, 0] + x[:, 1] ** 2 > 0.5, 1.0, -1.0)
    q, p, top = np.outer(y, y) * k.kernel(name, shift=1.0)(x, x), -np.ones(40), np.full(40, 0.7)
    a, b = k.solve_dual(q, p, y, top, np.zeros(40), tol=1e-6)
    assert abs(y @ a) < 1e-9 and (a >= 0).all() and (a <= top).all()
    margin = y * (q @ a * y + b)
    assert (margin[a < 1e-9] >= 1 - 1e-4).all() and (margin[a > 0.7 - 1e-9] <= 1 + 1e-4).all()
    free = (a > 1e-6) & (a < 0.7 - 1e-6)
    assert np.allclose(margin[free], 1, atol=1e-4)
    for _ in range(200):
        i, j = R.choice(40, 2, replace=False)
        s = R.normal() * 0.05
        c = a.copy()
        c[i] += y[i] * s
        c[j] -= y[j] * s
        if (c >= 0).all() and (c <= top).all():
            assert objective(q, p, c) >= objective(q, p, a) - 1e-6


def test_known_answers():
    x = R.uniform(-1, 1, (200, 2))
    y = np.sign(x[:, 0] * x[:, 1])
    rbf = k.kernel("rbf", gamma=2.0)
    assert (np.sign(k.support_classifier(x, y, rbf, 10.0)(x)) == y).mean() > 0.95
    r = k.relevance_classifier(x, y, rbf)
    assert (np.sign(r(x)) == y).mean() > 0.93 and r.kept < 40
    t = np.linspace(-10, 10, 120)[:, None]
    sinc = np.sinc(t[:, 0] / np.pi)
    wide = k.kernel("rbf", gamma=0.1)
    assert np.abs(k.support_regressor(t, sinc, wide, 10.0, 0.02)(t) - sinc).max() < 0.06
    f = k.relevance_regressor(t, sinc + 0.01 * R.normal(size=120), wide)
    assert np.abs(f(t) - sinc).max() < 0.05 and f.kept < 30
    inside = k.one_class(x, rbf, 0.2)
    assert 0.1 < (inside(x) < -1e-6).mean() < 0.25 and inside(np.array([[6.0, 6.0]]))[0] < 0


def test_rows_with_gaps_ties_and_no_rows(spark):
    rows = [(float(i % 7), float(i % 5) if i % 11 else None, "b" if i % 7 > 3 else "a") for i in range(80)]
    df = spark.createDataFrame(rows, "u double, v double, label string")
    got = k.fit("support_classifier", df, ["u", "v"], "label", sample=40)(df).collect()
    assert len(got) == 80
    for r in got:
        assert (r.score is None and r.prediction is None) if r.v is None else r.prediction == r.label
    assert k.fit("one_class", df, ["u"], None)(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two labels"):
        k.fit("support_classifier", df.filter("label = 'a'"), ["u"], "label")
    with pytest.raises(ValueError, match="no complete rows"):
        k.fit("relevance_regressor", df.limit(0), ["u"], "v")
