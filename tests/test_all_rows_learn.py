"""Maps and the copula learn from all rows: what differs stands where a sample by hash has next to nothing of it."""

import numpy as np

from tablewright.operators import reduction, simulation


def test_copula_sees_all_rows(spark):
    df = spark.range(12_000).selectExpr("cast(id as double) as a", "id + (id % 2) * 0.5D as b")
    got = simulation.copula(df, ["a", "b"], 60).toPandas()
    lo = np.floor(got.a)
    f = lambda x: x + x % 2 * 0.5
    assert np.allclose(got.b, f(lo) + (got.a - lo) * (f(lo + 1) - f(lo)), rtol=0, atol=0.01)  # between neighbours of all rows


def test_ica_matches_all_rows(spark):
    r = np.random.default_rng(3)
    s = np.column_stack([r.uniform(-1, 1, 5000), r.laplace(size=5000)])
    x = s @ np.array([[1.0, 0.4], [0.5, 1.0]])
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    z = reduction.reduce(df, ["a", "b"], "", "fast_ica", 2).toPandas()[["z1", "z2"]].to_numpy()
    assert np.allclose(np.cov(z.T), np.eye(2), atol=1e-6)  # white over all rows
    c = np.abs(np.corrcoef(np.c_[z, s].T)[:2, 2:])
    assert (c.max(1) > 0.99).all()


def test_nmf_sees_rare_rows(spark):
    n = 20_000
    df = spark.range(n).selectExpr(f"cast(id % 100 as double) as a", f"case when id >= {n - 2} then 1000.0D else 0.0D end as b")
    got = reduction.reduce(df, ["a", "b"], "", "nmf", 2).toPandas()
    w = got[["z1", "z2"]].to_numpy()
    assert np.isfinite(w).all() and np.linalg.matrix_rank(w, tol=1e-3) == 2
