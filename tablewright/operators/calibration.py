"""Calibration: reliability, decision curves, and maps from scores to probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.order import running


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal-width bins from 0, the last one closed; products are rounded at 9 digits so that edges do not move."""
    return stats.held(F.floor(F.round(p * bins, 9)), high=bins - 1)


def reliability(df: DataFrame, keys: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    return df.groupBy(*keys, bin_of(F.col(prob), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_p"), F.avg(label).alias("observed"))


def expected_error(df: DataFrame, keys: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return reliability(df, keys, label, prob, bins).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("worst"))


def maximum_error(df: DataFrame, label: str, prob: str, groups: int = 10) -> DataFrame:
    """Largest gap over equal-sized groups by (prediction, label), the first ones larger by one where they do not divide.

    Counts of equal pairs are what is ordered; a pair that spans a border is split by its count.
    """
    one = df.groupBy(prob, label).agg(F.count(F.lit(1)).alias("n"))
    runs = running(one, [], prob, {"end": ("sum", F.col("n"))}, [label], totals={"total": F.col("n")}).withColumn("start", F.col("end") - F.col("n"))
    base, extra = F.floor(F.col("total") / groups), F.col("total") % groups
    cut = lambda g: g * base + F.least(g, extra)
    split = runs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("m", F.least("end", cut(F.col("g") + 1)) - F.greatest("start", cut(F.col("g")))).filter("m > 0")
    means = split.groupBy("g").agg((F.sum(F.col("m") * F.col(label)) / F.sum("m")).alias("a"), (F.sum(F.col("m") * F.col(prob)) / F.sum("m")).alias("b"))
    return means.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("mce"))


def decision_curve(df: DataFrame, label: str, prob: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of treating from each threshold on, and of treating all; one pass over the rows."""
    sums = [F.struct(F.lit(float(t)).alias("threshold"), F.sum(((F.col(prob) >= t) & (F.col(label) == 1)).cast("double")).alias("tp"), F.sum(((F.col(prob) >= t) & (F.col(label) == 0)).cast("double")).alias("fp")) for t in thresholds]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("prev"), F.array(*sums).alias("_c"))
    t = F.col("threshold")
    rows = one.select("n", "prev", F.inline("_c"))
    return rows.select("threshold", ((F.col("tp") - F.col("fp") * t / (1 - t)) / F.col("n")).alias("net_benefit"), (F.col("prev") - (1 - F.col("prev")) * t / (1 - t)).alias("treat_all"))


def platt(df: DataFrame, label: str, score: str):
    """Logistic curve of one score; returns a function of a DataFrame that adds `probability`."""
    model = LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_p").fit(VectorAssembler(inputCols=[score], outputCol="_f").transform(df))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return lambda x: x.withColumn("probability", 1 / (1 + F.exp(-(a * F.col(score) + b))))


def isotonic(df: DataFrame, label: str, score: str, weight: str | None = None):
    """Pool-adjacent-violators map; a function that adds `probability`, linear between the steps and held beyond them."""
    ir = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="probability")
    if weight:
        ir.setWeightCol(weight)
    return ir.fit(df).transform


def isotonic_ensemble(df: DataFrame, label: str, score: str, row_id: str, folds: int = 5):
    """Mean of maps that each leave one fold out, held to 0..1."""
    fold = F.pmod(F.xxhash64(row_id), F.lit(folds))
    maps = [isotonic(df.filter(fold != k), label, score) for k in range(folds)]

    def apply(x: DataFrame) -> DataFrame:
        for k, f in enumerate(maps):
            x = f(x).withColumnRenamed("probability", f"_p{k}")
        mean = sum(F.col(f"_p{k}") for k in range(folds)) / folds
        return x.withColumn("probability", stats.held(mean, 0.0, 1.0)).drop(*(f"_p{k}" for k in range(folds)))

    return apply


def detrend(df: DataFrame, label: str, pred: str) -> DataFrame:
    """slope and intercept of the error on the label."""
    e = F.col(pred) - F.col(label)
    return df.agg(F.regr_slope(e, F.col(label)).alias("slope"), F.regr_intercept(e, F.col(label)).alias("intercept"))


def apply_detrend(df: DataFrame, pred: str, line: DataFrame) -> DataFrame:
    """Predictions with the error that the inverse line estimates taken out."""
    x = (F.col(pred) - F.col("intercept")) / (1 + F.col("slope"))
    return df.join(F.broadcast(line), F.lit(True)).withColumn("corrected", x).drop("slope", "intercept")  # a line is one row


def label_transform(y: Column, kind: str, low: float = 0.0, high: float = 1.0, power: float = 1.0) -> Column:
    if kind == "scale":
        return (y - low) / (high - low)
    return F.pow(y, power) if kind == "power" else F.ln(y)


