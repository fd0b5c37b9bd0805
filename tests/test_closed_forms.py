import math
from itertools import combinations

import numpy as np
import pytest

from tablewright.functions.order import running
from tablewright.operators import closed_forms as c
from pyspark.sql import functions as F


def test_running_orders_far_tails_narrow_bands_and_words(spark):
    r = np.random.default_rng(1)
    values = [*(1e9 + r.random(300)), *(-(10.0 ** r.integers(-12, 12, 200))), 0.0, 1e-300, -1e-300, 1e300, *r.normal(size=200)]
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for keys in ([], ["k"]):
        for down in (False, True):
            got = {x.id: (x.place, x.most, x.n) for x in running(df, keys, "v", {"place": ("sum", F.lit(1)), "most": ("max", F.col("id"))}, ["id"], down, {"n": F.lit(1)}).collect()}
            for key in {x[1] if keys else 0 for x in rows}:
                own = sorted((x for x in rows if not keys or x[1] == key), key=lambda x: (-x[2] if down else x[2], x[0]))
                for place, x in enumerate(own, 1):
                    assert got[x[0]] == (place, max(y[0] for y in own[:place]), len(own))
    words = spark.createDataFrame([(w,) for w in ("b", "", "aé", "ab", "abcdef", "abcdeg", "zz", "é")], "w string")
    got = {x.w: x.n for x in running(words, [], "w", {"n": ("sum", F.lit(1))}).collect()}
    assert got == {w: i for i, w in enumerate(sorted(got, key=lambda x: x.encode()), 1)}


def test_pairwise_scales(spark):
    r = np.random.default_rng(3)
    for n in (2, 9, 40, 41):
        x = np.round(r.normal(size=n) * 3, 1)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        d = np.abs(x[:, None] - x[None, :])
        h = n // 2 + 1
        qn = np.sort(d[np.triu_indices(n, 1)])[math.comb(h, 2) - 1]
        sn = np.sort(np.sort(d, 1)[:, n // 2])[(n + 1) // 2 - 1]
        assert c.pairwise_scale(df, "x", "qn").first()[0] == pytest.approx(2.2219 * qn)
        assert c.pairwise_scale(df, "x", "sn").first()[0] == pytest.approx(1.1926 * sn)


def test_subsets_and_combinations(spark):
    every = list(combinations(range(1, 8), 3))
    got = spark.range(0, 40).select("id", c.combination_at(F.col("id"), 7, 3).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [None, *every, None, None, None, None]
    rows = c.random_subsets(spark, 9, 3, 30).groupBy("subset").agg(F.sort_array(F.collect_list("feature")).alias("x")).collect()
    assert len(rows) == 30 == len({tuple(r.x) for r in rows}) and all(len(set(r.x)) == 3 for r in rows)
    assert c.random_subsets(spark, 5, 2, 99).select("subset").distinct().count() == 10


def test_spatial_median_and_nearest_spd(spark):
    pts = np.random.default_rng(2).normal(size=(200, 2)) + [3, -1]
    pts[:20] += 100
    at = c.spatial_median(spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double"), ["a", "b"])
    cost = lambda z: np.sqrt(((pts - z) ** 2).sum(1)).sum()
    assert all(cost(np.array(at)) <= cost(np.array(at) + d) + 1e-6 for d in 0.05 * np.array([[1, 0], [0, 1], [-1, 0], [0, -1]]))
    a = np.array([[1.0, 2.0, 0], [2.0, 1.0, 0], [0, 0, -3.0]])
    b = c.nearest_spd(a)
    assert np.allclose(b, b.T) and np.linalg.eigvalsh(b).min() > 0 and np.linalg.norm(a - b) <= 3.7
