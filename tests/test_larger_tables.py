"""What failed on tables of 0.1 to 1 GB: time that grew with the square, limits on rows, ties that hung on the order of sums."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import exact_near, model_building, neighbours, preprocess, validation
from tablewright.plans import validation_queries


def test_yekutieli_takes_linear_time(spark):
    began = time.time()
    n = 60_000
    got = validation.fdr(spark.range(1, n + 1).select("id", (F.col("id") / (200.0 * n)).alias("p")), "p", "id", dependent=True)
    low, high = got.agg(F.min("adjusted"), F.max("adjusted")).first()
    want = (1 / np.arange(1, n + 1)).sum() / 200
    assert low == pytest.approx(want, rel=1e-12) and high == pytest.approx(want, rel=1e-12)
    assert time.time() - began < 60


@pytest.mark.parametrize("n", [1, 2, 32, 33, 1000])
def test_harmonic(spark, n):
    assert spark.range(1).select(validation._harmonic(F.lit(n).cast("long"))).first()[0] == pytest.approx(sum(1 / i for i in range(1, n + 1)), rel=1e-14)


def test_equal_means_are_ties(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last digit."""
    rows = [(b, t, x) for b in range(8) for t in (1, 2) for x in ((0.1, 0.2, 0.3) if t == 1 else (0.3, 0.2, 0.1))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double").coalesce(1)
    means = validation_queries.blocks(lambda _: df).collect()
    assert len(means) == 16 and len({r.x for r in means}) == 1
    assert validation.block_ranks(validation_queries.blocks(lambda _: df), "block", "l_linenumber", "x", False).first().statistic == pytest.approx(0)


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine", "hamming", "squared"])
def test_boxes_find_what_brute_force_finds(metric):
    rng = np.random.default_rng(1)
    x, q = rng.integers(0, 9, (3000, 3)).astype(float), rng.integers(0, 9, (300, 3)).astype(float)
    x = x[np.lexsort(x.T[::-1])]
    if metric == "squared":
        far = ((q[:, None] - x[None]) ** 2).mean(-1)
    else:
        far = neighbours._metric(q, x, metric)
    far = np.round(far, 12)
    want = np.argsort(far, axis=1, kind="stable")[:, :5]
    d, i = exact_near.Boxes(x, 5, metric, 12).near(q)
    assert np.array_equal(d, np.take_along_axis(far, want, 1))
    assert np.array_equal(x[i], x[want])
    if metric == "hamming":
        d, r = exact_near.matched(x, np.ones(3, bool), q, 5)
        assert np.array_equal(d, np.take_along_axis(far, want, 1)) and np.array_equal(r, x[want])


def test_many_queries_as_few(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_LIMIT", 1000)
    monkeypatch.setattr(exact_near, "PART", 700)
    df = spark.range(2000).select("id", F.array((F.col("id") % 40).cast("double"), (F.col("id") % 7).cast("double")).alias("v"))
    want = {(r.q, r.b): r.d for r in neighbours.search_all(df, df, "id", "v", 3).collect()}
    assert {(r.q, r.b): r.d for r in exact_near.search_many(df, df, "id", "v", 3).collect()} == want


def test_imputation_takes_more_than_100_000_rows(spark):
    df = spark.range(100_050).select(F.when(F.col("id") > 0, F.col("id").cast("double")).alias("a"), F.col("id").cast("double").alias("b"))
    assert preprocess.impute_knn(df, df, ["a", "b"], 3).filter("b = 0").first().a == 2


def test_labels_of_more_than_20_000_rows(spark):
    df = spark.range(50_000).select("id", F.array(F.col("id").cast("double")).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("label"))
    got = model_building.impute_labels(df, "id", "v", "label")
    assert got.count() == 25_000 and got.filter("label <> id - 1").count() == 0


def test_sequential_takes_more_than_20_000_rows(spark):
    df = spark.range(21_000).select("id", F.when(F.col("id") % 50 > 0, F.col("id").cast("double")).alias("a"), F.col("id").cast("double").alias("b"))
    got = model_building.impute_sequentially(df, "id", ["a", "b"], 2)
    assert got.filter("id % 50 = 0 and id > 0 and abs(a - id) > 1e-9").count() == 0 and got.count() == 21_000


@pytest.mark.parametrize("n", [30, 300])
def test_nearest_match_is_the_best_of_all(spark, n):
    """Many queries in one place, so that the k nearest do not do at first."""
    rng = np.random.default_rng(n)
    x = np.r_[rng.normal(0, 0.01, (n // 3, 2)), rng.normal(0, 1, (n - n // 3, 2))]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, v array<double>")
    q = list(range(n // 3))
    got = neighbours.assign_nearest(df, df.filter(F.col("id") < n // 3), "id", "v", 2).collect()
    cost = np.linalg.norm(x[q][:, None] - x[None], axis=2) + 1e9 * np.eye(n)[q]
    assert sorted(r.q for r in got) == q and len({r.b for r in got}) == len(q)
    assert sum(cost[r.q, r.b] for r in got) == pytest.approx(cost[q, neighbours.hungarian(cost)].sum())
