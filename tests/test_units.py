import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import special, stats
from tablewright.operators import neighbours, numeric, preprocess, ranking, relational, validation
from tablewright.sources import io
from tablewright.streaming import events


def test_hazen_constants(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "x double")
    assert [r.q for r in stats.hazen(df, [], "x", [0.1, 0.25, 0.5, 0.9]).orderBy("p").collect()] == [1, 1.5, 3, 8]


def test_skewness_and_kurtosis(spark):
    r = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double").agg(F.skewness("x").alias("s"), F.kurtosis("x").alias("k")).first()
    assert abs(r.s - 0.6568077) < 1e-6 and abs(r.k + 0.9989792 + 0.1) < 1e-6


def test_diagnostic_table():
    d = validation.diagnostics(731, 270, 78, 1500)
    assert abs(d["dor"] - 52.0655) < 1e-3 and abs(d["accuracy"] - 0.865) < 1e-3 and abs(d["youden"] - 0.7510) < 1e-3


def test_distributions():
    assert abs(special.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(special.f_tail(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(special.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(special.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    assert abs(special.normal_cdf(1.959964) - 0.975) < 1e-6 and abs(special.normal_inverse(0.975) - 1.959964) < 1e-5


def test_hungarian_matches_search():
    from itertools import permutations

    r = np.random.default_rng(0)
    for _ in range(20):
        c = r.random((4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert abs(c[np.arange(4), neighbours.hungarian(c)].sum() - best) < 1e-9


def test_combinations_and_bootstrap(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "x long")
    assert relational.combinations(df, "x", 4).count() == 35
    many = relational.bootstrap(spark.range(20000), "id", 1).count()
    assert 19000 < many < 21000


def test_scaler_sees_training_rows_only(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 20.0)], "i long, x double")
    got = {r.i: r.x for r in preprocess.scale(df, df.filter("i < 3"), ["x"]).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0}
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i long, x double")
    assert {r.x for r in preprocess.scale(same, same, ["x"], 2).collect()} == {0.0}


def test_combat_brings_batches_together(spark):
    r = np.random.default_rng(1)
    rows = [(b, *(r.normal(0, 1, 5) + b).tolist()) for b in range(3) for _ in range(100)]
    df = spark.createDataFrame(rows, "batch long, " + ", ".join(f"f{k} double" for k in range(5)))
    cols = [f"f{k}" for k in range(5)]
    means = preprocess.combat(df, df, cols, "batch").groupBy("batch").agg(F.avg("f0").alias("m")).collect()
    assert max(x.m for x in means) - min(x.m for x in means) < 0.2


def test_informative_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 0.0), (2.0, 1.0, 3.0, 0.0), (3.0, 1.0, 4.0, 1.0)], "a double, b double, c double, d double")
    assert preprocess.keep_informative(df, list("abcd")) == ["a", "d"]
    assert preprocess.keep_informative(df, list("abcd"), 60.0) == ["a"]


def test_greedy_selection_avoids_copies(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 2000)
    a, b = y + r.normal(0, 0.5, 2000), y + r.normal(0, 0.6, 2000)
    df = spark.createDataFrame([(int(k), float(p), float(p), float(q)) for k, p, q in zip(y, a, b, strict=True)], "y int, a double, copy double, b double")
    assert [x.feature for x in ranking.greedy(df, ["a", "copy", "b"], "y", "mrmr").orderBy("place").collect()][:2] == ["a", "b"]


def test_linkage_heights_grow():
    x = np.array([[0.0], [0.1], [1.0], [1.1], [5.0]])
    h = [m[2] for m in numeric.average_linkage(np.abs(x - x.T))]
    assert h == sorted(h) and len(h) == 4


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tx\ty\n1\t2.5\tNA\n2\tNaN\t7\n3\t4\tz\n")
    df = io.read_table(spark, str(tmp_path / "t.tsv"), "tsv")
    assert dict(df.dtypes) == {"id": "double", "x": "double", "y": "string"}
    assert [(r.x, r.y) for r in df.orderBy("id").collect()] == [(2.5, None), (None, "7"), (4.0, "z")]
    for fmt in ("csv", "tsv", "json", "parquet"):
        io.write_table(df, str(tmp_path / fmt), fmt)
        assert io.read_table(spark, str(tmp_path / fmt), fmt).count() == 3
    assert io.roles(df, "id", "y")["features"] == ["x"]
    with pytest.raises(ValueError):
        io.roles(df, "nothing", None)


def test_volumes(spark, tmp_path):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 2, 1, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<3f", head, 108, 352.0, 2.0, 1.0)
    (tmp_path / "a.nii").write_bytes(bytes(head) + np.array([1, 2, 3, 4], "<f4").tobytes())
    assert io.read_volumes(spark, str(tmp_path / "a.nii")).first()["values"] == [3.0, 5.0, 7.0, 9.0]
    assert io.read_volumes(spark, str(tmp_path / "a.nii"), [0, 3]).first()["values"] == [3.0, 9.0]


def test_stream(spark, tmp_path, sf):
    static = spark.read.parquet(f"{sf}/events.parquet")
    static.repartition(3).write.parquet(str(tmp_path / "in"))
    live = events.read_events(spark, str(tmp_path / "in"), static.schema, 1)
    q = events.windowed(live, "ts", ["event_type"], "value", late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    assert got == {(r.start, r.event_type): r.n for r in events.windowed(static, "ts", ["event_type"], "value").collect()}
