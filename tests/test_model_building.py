import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import model_building as b


def frame(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 2))
    x = np.column_stack([z[:, 0] * 3 + 5, z[:, 0] + 0.3 * z[:, 1], z[:, 1], z[:, 0] + 0.01 * r.normal(size=n)])
    return x, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, cov double")


def test_unseen_rows_take_the_training_rows_map(spark):
    x, df = frame(spark)
    chain = b.Chain(b.standardising(["a", "b", "c"]), b.principal_components(["a", "b", "c"], 2)).fit(df.filter("id < 200"))
    got = chain.apply(df.filter("id >= 200")).orderBy("id").toPandas()
    t = (x[:200, :3] - x[:200, :3].mean(0)) / x[:200, :3].std(0, ddof=1)
    _, _, v = np.linalg.svd(t - t.mean(0), full_matrices=False)
    w = v[:2].T * np.sign(v[:2].T[np.abs(v[:2].T).argmax(0), [0, 1]])
    want = ((x[200:, :3] - x[:200, :3].mean(0)) / x[:200, :3].std(0, ddof=1)) @ w
    assert np.allclose(got[["pc1", "pc2"]].to_numpy(), want)
    with pytest.raises(ValueError):
        b.Chain(b.standardising(["a"])).apply(df)


def test_covariate_components_go(spark):
    x, df = frame(spark)
    out = b.without_components_of(["a", "b", "c"], ["cov"], 0.5)(df)(df).toPandas()
    assert max(abs(np.corrcoef(out[c], x[:, 3])[0, 1]) for c in "abc") < 0.35
    same = b.without_components_of(["a", "b", "c"], ["cov"], 1.01)(df)(df).toPandas()
    assert np.allclose(same[["a", "b", "c"]].to_numpy(), x[:, :3])


def test_sequential_imputation(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 3))
    gone = r.random((60, 3)) < 0.2
    gone[:5] = False
    rows = [(i, *(None if g else float(v) for v, g in zip(xs, gs, strict=True))) for i, (xs, gs) in enumerate(zip(x, gone, strict=True))]
    got = b.impute_sequentially(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", ["a", "b", "c"], 3).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
    want = np.where(gone, np.nan, x)
    pool = [v for v in want if not np.isnan(v).any()]
    for i in sorted(range(60), key=lambda i: (gone[i].sum(), i)):
        if gone[i].any():
            k = ~gone[i]
            d = [np.mean((p[k] - want[i][k]) ** 2) if k.any() else 1.0 for p in pool]
            near = sorted(range(len(pool)), key=lambda j: (d[j], j))[:3]
            w = np.array([1 / max(math.sqrt(d[j]), 1e-12) for j in near])
            want[i][~k] = sum(wi * pool[j][~k] for wi, j in zip(w, near, strict=True)) / w.sum()
            pool.append(want[i])
    assert np.allclose(got, want)


def test_ensembles_from_patterns(spark):
    r = np.random.default_rng(5)
    y = r.choice([-1.0, 1.0], 400)
    h = np.column_stack([np.where(r.random(400) < p, y, -y) for p in (0.9, 0.75, 0.7, 0.5)])
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(h, y, strict=True)], "a double, b double, c double, d double, y double")
    p = b.vote_patterns(df, list("abcd"), "y")
    assert p[2].sum() == 400
    w, want = np.ones(400) / 400, []
    for j in range(4):
        e = w[h[:, j] != y].sum()
        a = 0.5 * math.log((1 - e) / e)
        w = w * np.exp(-a * y * h[:, j])
        w /= w.sum()
        want.append(a)
    assert np.allclose(b.boosting_weights(*p), want)
    s = np.sign(h[:, [0, 1, 3]].sum(1)) * y
    assert b.ensemble_worth(*p, [0, 1, 3], "accuracy") == pytest.approx(((s > 0) + 0.5 * (s == 0)).mean())
    dis = np.mean([(h[:, i] != h[:, j]).mean() for i, j in ((0, 1), (0, 2), (1, 2))])
    assert b.ensemble_worth(*p, [0, 1, 2], "diversity") == pytest.approx(dis)
    kept = b.build_ensemble(*p)
    assert 0 in kept and b.ensemble_worth(*p, kept, "accuracy") >= b.ensemble_worth(*p, range(4), "accuracy")


def test_binning_calibrates(spark):
    r = np.random.default_rng(6)
    p = r.random(3000)
    y = (r.random(3000) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(t)) for a, t in zip(p, y, strict=True)], "p double, y int").unionByName(spark.createDataFrame([(None, 1)], "p double, y int"))
    models = b.bbq(df, "p", "y")
    assert sum(w for w, _, _ in models) == pytest.approx(1, abs=1e-3)
    got = b.bbq_apply(df, "p", models, "q").toPandas()
    assert got.q.isna().sum() == 1
    got = got.dropna()
    assert np.abs(got.q - got.p**2).mean() < 0.05 < np.abs(got.p - got.p**2).mean()


def test_searches_find_the_best_of_a_smooth_grid():
    grid = {"x": list(range(9)), "y": list(range(9))}
    worth = lambda p: -((p[0] - 6) ** 2) - (p[1] - 2) ** 2
    point, value, tried = b.anneal(worth, grid, 200)
    assert point == (6, 2) and value == 0 and tried < 81
    point, value, tried = b.bayes_search(worth, grid, 4, 24)
    assert value >= -1 and tried == 28


def test_hybrid_distance(spark):
    df = spark.createDataFrame([("u", 1.0, "v", 4.0)], "a_n string, a_x double, b_n string, b_x double")
    assert df.select(b.hybrid_distance(["n"], ["x"], "a_", "b_", {"x": 0.0}, {"x": 10.0})).first()[0] == pytest.approx(0.65)
    assert df.select(b.hybrid_distance(["n"], [], "a_", "a_", {}, {})).first()[0] == 0
