"""Moment forms against the formulas on whole matrices, ReliefF against loops, JSON paths and exports."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest

from tablewright.functions import special
from tablewright.operators import moment_forms as m
from tablewright.operators import ranking
from tablewright.sources import io

R = np.random.default_rng(7)
COLS = list("abcd")


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame(x, columns=COLS[: x.shape[1]]).assign(**more))


@pytest.mark.parametrize("n", [6, 60])
def test_analytic_p(spark, n):
    x, y = R.normal(size=(n, 4)) + [1, 0, -2, 0], np.where(np.arange(n) % 3 == 0, 1, -1)
    w = np.array([0.5, -2.0, 0.1, 0.0])
    p, j = (y == 1).mean(), np.ones((n, 1))
    inv = np.linalg.pinv(x @ x.T)
    c = x.T @ (inv - inv @ j @ j.T @ inv / (j.T @ inv @ j))
    mean, sd = c.sum(1) * (2 * p - 1), np.sqrt((c**2).sum(1) * (4 * p - 4 * p * p))
    d = np.sqrt((sd**2 + mean**2).sum())
    want = [2 * special.normal_cdf(-abs(a - b) / s) for a, b, s in zip(w / np.linalg.norm(w), mean / d, sd / d, strict=True)]
    got = {r.feature: r.p for r in m.analytic_p(frame(spark, x, y=y), COLS, "y", 1, w).collect()}
    assert [got[c] for c in COLS] == pytest.approx(want, rel=1e-5, abs=1e-12)


def test_match_and_merge(spark):
    x = R.normal(size=(80, 4))
    x[:, 2] = -x[:, 0] + 0.1 * x[:, 2]
    df = frame(spark, x)
    r = np.corrcoef(x.T)
    best = max(itertools.permutations([2, 3]), key=lambda q: sum(abs(r[i, k]) for i, k in enumerate(q)))
    got = {g.reference: g for g in m.match_components(df, ["c", "d"], ["a", "b"]).collect()}
    assert [got[c].component for c in "ab"] == [COLS[k] for k in best] and got["a"].sign == -1
    few = {g.reference: g.component for g in m.match_components(df, ["c"], ["a", "b"], least=0.5).collect()}
    assert few == {"a": "c", "b": None}
    merged = {g.reference: g for g in m.merge_references(df, COLS, 0.8).collect()}
    assert merged["c"].kept == "a" and merged["a"]["count"] == 2 and merged["b"].kept == "b"
    kept = sum(merged[c].weight * x[:, COLS.index(c)] for c in "ac")
    want = (x[:, 0] - x[:, 2]) / 2
    assert np.allclose(kept, want / np.linalg.norm(want))
    assert all(g.kept == g.reference for g in m.merge_references(df, COLS, 1.0).collect())


def test_component_cases(spark):
    x = R.multivariate_normal([1, 2, 3], [[2, 1, 0], [1, 3, 0], [0, 0, 0.5]], 400)
    df = frame(spark, np.column_stack([x, np.arange(400) % 2]))
    got = m.component_cases(df, COLS, 4000, 3).toPandas()
    assert len(got) == 4000 and set(got.d) == {0.0, 1.0}
    assert np.allclose(got[COLS[:3]].mean(), x.mean(0), atol=0.15) and np.allclose(np.cov(got[COLS[:3]].T), np.cov(x.T), atol=0.35)


def test_probabilistic_map_is_where_em_ends():
    x = R.normal(size=(300, 2)) @ R.normal(size=(2, 4)) + 0.4 * R.normal(size=(300, 4))
    s = np.cov(x.T)
    w, noise = R.normal(size=(4, 2)), 1.0
    for _ in range(3000):
        inv = np.linalg.inv(w.T @ w + noise * np.eye(2))
        new = s @ w @ np.linalg.inv(noise * np.eye(2) + inv @ w.T @ s @ w)
        noise = np.trace(s - s @ w @ inv @ new.T) / 4
        w = new
    got, found = m.probabilistic_map({"cov": s}, 2)
    assert found == pytest.approx(noise, rel=1e-4)
    proj = w @ np.linalg.inv(w.T @ w + noise * np.eye(2))
    assert np.allclose(got @ got.T, proj @ proj.T, rtol=1e-3)


def test_relief_over_all_rows(spark):
    x, y = np.round(R.normal(size=(60, 3)), 6), (np.arange(60) % 3).tolist()
    x[:, 1] += np.array(y) * 2
    z = (x - x.min(0)) / np.ptp(x, axis=0)
    want, k, y = np.zeros(3), 4, np.array(y)
    for i in range(60):
        for c in range(3):
            at = np.array([j for j in np.flatnonzero(y == c) if j != i])
            near = at[np.argsort(np.abs(z[at] - z[i]).sum(1))[:k]]
            want += np.abs(z[near] - z[i]).mean(0) * (-1 if c == y[i] else (1 / 3) / (2 / 3)) / 60
    got = {r.feature: r.weight for r in ranking.relief(frame(spark, x, y=y), COLS[:3], "y", k, cases=99).collect()}
    assert [got[c] for c in COLS[:3]] == pytest.approx(want.tolist())
    assert ranking.relief(frame(spark, x, y=y).limit(0), COLS[:3], "y").count() == 0


def test_json_paths_and_exports(spark, tmp_path):
    text = ['{"a": {"b": [1, {"c": 3}]}, "d": 3}', "[3]", "not json", None, '{"a": 4}']
    df = spark.createDataFrame(list(enumerate(text)), "id long, j string")
    got = {r.id: r.paths for r in io.find_in_json(df, "j", lambda v: v == 3).collect()}
    assert got == {0: ["$.a.b[1].c", "$.d"], 1: ["$[0]"], 2: [], 3: None, 4: []}
    at = str(tmp_path / "out")
    io.export_results(df.filter("id < 2"), at, "parquet", {"made": "by a test"})
    assert io.linked(spark, f"{at}/table").count() == 2 and io.linked(spark, df) is df
    assert json.loads(spark.read.text(f"{at}/about").first()[0]) == {"made": "by a test", "columns": {"id": "bigint", "j": "string"}}
