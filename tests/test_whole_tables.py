"""Registered queries and their operators take all rows of their tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import catalog
from tablewright.operators import neighbours, numeric, preprocess, ranking, simulation


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine", "hamming"])
def test_knn_imputation(spark, sf, metric):
    got = {r.p_partkey: (r.a, r.b) for r in catalog.queries()[f"impute_knn_{metric}"](spark, sf).collect()}
    rows = sorted((r.p_partkey, float(r.p_size) if r.p_partkey % 4 else np.nan, float(r.p_retailprice) if r.p_partkey % 5 else np.nan, float(r.p_partkey % 11)) for r in read(spark, sf, "part").collect())
    assert sorted(got) == [r[0] for r in rows]
    pool = np.array([r[1:] for r in rows if not np.isnan(r[1:]).any()])
    for key, *x in rows:
        x = np.array(x)
        have = ~np.isnan(x)
        d = neighbours._metric(x[None, have], pool[:, have], metric)[0]
        at = np.sort(d)[:5]
        if not have.all() and (d <= at[-1] + 1e-12).sum() == 5:  # no tie at the fifth place
            x[~have] = np.median(pool[d <= at[-1] + 1e-12][:, ~have], axis=0)
            assert got[key] == pytest.approx(tuple(x[:2]))
        assert None not in got[key] and not np.isnan(got[key]).any()


@pytest.mark.parametrize(("name", "module", "f"), [("rank_linear_svm", ranking, "linear_svm"), ("search_grid", simulation, "grid_search")])
def test_learns_from_all_lines(spark, sf, monkeypatch, name, module, f):
    seen = []
    monkeypatch.setattr(module, f, lambda df, *_: seen.append(df.count()))
    catalog.queries()[name](spark, sf)
    assert seen == [read(spark, sf, "lineitem").count()]


def test_gower(spark, sf):
    part = {r.p_partkey: r for r in read(spark, sf, "part").collect()}
    span = [max(float(r[c]) for r in part.values()) - min(float(r[c]) for r in part.values()) for c in ("p_size", "p_retailprice")]
    same = lambda a, b: (1 - abs(a.p_size - b.p_size) / span[0] + 1 - abs(float(a.p_retailprice) - float(b.p_retailprice)) / span[1] + (a.p_brand == b.p_brand)) / 3
    want = {(i, j): same(part[i], part[j]) for i in part if i % 50 == 0 for j in part if i != j}
    got = {(r.i, r.j): r.s for r in catalog.queries()["similarity_gower"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_gower_makes_its_pairs_in_many_tasks(spark, sf):
    """A small file is one task, which would make all pairs; the numbers are DuckDB's to the last bit."""
    got = catalog.queries()["similarity_gower"](spark, sf)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    part = duckdb.read_parquet(f"{sf}/part.parquet")  # noqa: F841
    assert sorted(tuple(r) for r in got.collect()) == sorted(duckdb.sql(catalog.oracle_sql()["similarity_gower"]).fetchall())


def test_gower_skips_missing_parts(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, None, "a"), (3, 10.0, None), (4, None, None)], "k long, x double, c string")
    got = {(r.i, r.j): r.s for r in numeric.gower(rows, "k", ["x"], ["c"]).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): None, (1, 4): None, (2, 4): None, (3, 4): None}


def test_gower_output_is_small_on_disk(spark, sf, tmp_path):
    """Larger sizes are copies of a table: written out, a pair of these took 0.83 bytes while copies stood apart."""
    part = read(spark, sf.replace("0.001", "0.01"), "part").crossJoin(spark.range(10)).withColumn("p_partkey", F.expr("p_partkey + 10000 * id")).drop("id")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    catalog.queries()["similarity_gower"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    n, out = part.count(), spark.read.parquet(f"{tmp_path}/out")
    asked = part.filter("p_partkey % 50 = 0").count()
    assert out.count() == asked * (n - 1) and out.filter("i = j").isEmpty() and out.groupBy("j").count().filter(f"count < {asked - 1}").isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < asked * n / 2


def test_gower_of_odd_rows(spark):
    """Keys of any kind, missing and NaN parts, rows of one value, kinds that no query has; more than a block of them."""
    odd = [("a", 1.0, "x", -0.0), ("b", None, "y", 0.0), ("c", float("nan"), None, 1.0), ("d", 5.0, "x", None), (None, 9.0, "x", 0.0), ("e", None, None, None)]
    rows = spark.createDataFrame(odd + [(f"f{i}", 3.0, "z", 0.0) for i in range(300)], "k string, v double, c string, d double")
    got = {(r.i, r.j): r.s for r in numeric.gower(rows, "k", ["v"], ["c", "d"], rows.filter("k < 'f'")).collect()}
    assert len(got) == 5 * 304 and all(i != j for i, j in got)
    assert [got["a", k] for k in "bcde"] == [0.5, 0.0, 0.75, None] and got["b", "c"] == 0.0 and got["d", "b"] == 0.0
    assert {got["a", f"f{i}"] for i in range(300)} == {round((1 - 2 / 8 + 1) / 3, 9)} and {got["e", f"f{i}"] for i in range(300)} == {None}
    assert numeric.gower(rows, "k", ["v"], ["c"], rows.filter("k = 'none'")).count() == 0 and numeric.gower(rows.filter("v > 99"), "k", ["v"], ["c"]).count() == 0
    assert numeric.gower(rows, "k", ["v"], ["c"]).count() == 305 * 304 // 2


def test_assignment(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in read(spark, sf, "embeddings").collect()}
    q = [i for i in sorted(rows) if i % 50 == 0]
    cost = np.array([[np.linalg.norm(rows[i] - rows[j]) if i != j else 1e9 for j in sorted(rows)] for i in q])
    got = catalog.queries()["assignment"](spark, sf).collect()
    assert sorted(r.q for r in got) == q and len({r.b for r in got}) == len(q)
    least = cost[np.arange(len(q)), neighbours.hungarian(cost)].sum()
    assert sum(np.linalg.norm(rows[r.q] - rows[r.b]) for r in got) == pytest.approx(least)


def test_neighbours_among_all_rows(spark):
    f = lambda a: a * a / 100
    df = spark.createDataFrame([(float(i), f(i)) for i in range(4000)], "a double, b double")
    for r in simulation.between_neighbours(df.select("a", "b"), ["a", "b"], 150, k=1).collect():
        lo = np.floor(r.a)
        assert r.b == pytest.approx(f(lo) + (r.a - lo) * (f(lo + 1) - f(lo)), abs=1e-6)
    assert neighbours.numbered(df).count() == 4000


def test_oversampling_counts_all_rows(spark):
    """The minority stands behind 50,000 others, in two groups: only one is among the others."""
    many = [(0, float(i), 0.0) for i in range(50_000)]
    few = [(1, i + 0.5, 0.0) for i in range(30)] + [(1, float(i), 1e6) for i in range(30)]
    df = spark.createDataFrame(many + few, "y int, a double, b double")
    made = preprocess.oversample(df, ["a", "b"], "y").toPandas()
    assert len(made) == 50_000 - 60 and set(made.y) == {1}
    assert (made.b == 0).all() and made.a.between(0.5, 29.5).all()


def test_oversampling_small(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_LIMIT", 3)
    df = spark.createDataFrame([(0, float(i)) for i in range(100, 120)] + [(1, float(i)) for i in range(7)] + [(1, 0.0), (None, 5.0), (1, None)], "y int, a double")
    made = preprocess.oversample(df, ["a"], "y", k=2).toPandas()
    assert len(made) == 12 and made.a.between(0, 6).all()
    assert preprocess.oversample(df.filter("y = 0"), ["a"], "y").count() == 0
    one = preprocess.oversample(df.filter("y = 0 or a = 6"), ["a"], "y").toPandas()
    assert len(one) == 19 and (one.a == 6).all()


def test_pandas_weights_refuses(spark):
    df = spark.range(11).selectExpr("id as y", "id as a")
    assert ranking.pandas_weights(df, lambda p: [len(p)], ["a"], "y").first().weight == 11
    with pytest.raises(ValueError):
        ranking.pandas_weights(df, lambda p: [1.0], ["a"], "y", 10)
