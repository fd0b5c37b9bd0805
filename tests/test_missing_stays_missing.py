"""Where values are held to a range, a missing one must not turn into the bound."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import calibration, closed_forms, numeric, preprocess, relational, validation

ROWS = [(0, 1.0), (1, 2.0), (2, None), (3, 4.0), (4, 9.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, v double")


def values(df, column="v"):
    return {r["id"]: r[column] for r in df.collect()}


def test_held_values(df):
    got = values(preprocess.standardise(df, df, "v", winsor=1.0))
    assert got[2] is None and got[4] < 1.5
    assert values(preprocess.discretise(df, df, "v"))[2] is None
    assert values(closed_forms.redundancy_penalty(df, "v", 0.0, 4.0, 2.0, "pen"), "pen") == {0: 0.5, 1: 1.0, 2: None, 3: 2.0, 4: 2.0}
    assert values(numeric.interpolate(df, "v", [(0.0, 0.0), (4.0, 8.0)], "y"), "y") == {0: 2.0, 1: 4.0, 2: None, 3: 8.0, 4: 8.0}
    assert values(df.withColumn("b", calibration.bin_of(F.col("v") / 9)), "b") == {0: 1, 1: 2, 2: None, 3: 4, 4: 9}


def test_missing_p_and_points(spark, df):
    p = spark.createDataFrame([("a", 0.1), ("a", None), ("a", 0.5)], "g string, p double")
    assert validation.fisher_combine(p, ["g"], "p").first().statistic == pytest.approx(-2 * (math.log(0.1) + math.log(0.5)))
    two = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, None), (None, 5.0)], "x double, y double")
    assert closed_forms.spatial_median(two, ["x", "y"]) == pytest.approx(closed_forms.spatial_median(two.dropna(), ["x", "y"]))


def test_equalise_without_spread(spark, df):
    assert relational.equalise(df, "v", "id", 2).filter("v is null").count() == 0
    same = spark.createDataFrame([(0, 3.0), (1, 3.0)], "id long, v double")
    assert relational.equalise(same, "v", "id", 4).count() == 2
