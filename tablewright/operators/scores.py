"""Curves, confusion tables and multi-class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def auc_interval(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Hanley-McNeil limits from auc and the class sizes np, nn."""
    a = F.col("auc")
    q1, q2 = a / (2 - a) - a * a, 2 * a * a / (1 + a) - a * a
    se = F.sqrt((a * (1 - a) + (F.col("np") - 1) * q1 + (F.col("nn") - 1) * q2) / (F.col("np") * F.col("nn")))
    return df.withColumns({"low": a - z * se, "high": a + z * se})


def roc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the largest down."""
    one = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum((F.col(label) > 0).cast("long")).alias("a"), F.sum((F.col(label) < 0).cast("long")).alias("b"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return one.select(*keys, "threshold", F.sum("a").over(down).alias("tp"), F.sum("b").over(down).alias("fp"), F.sum("a").over(w).alias("pos"), F.sum("b").over(w).alias("neg"))


def confusion(df: DataFrame, label: str, pred: str, classes: Sequence[str]) -> DataFrame:
    return df.groupBy(label).pivot(pred, list(classes)).count().na.fill(0, list(classes))


def one_vs_rest(df: DataFrame, label: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """class_, sensitivity, specificity, bac from the table of counts, not from copies of the rows."""
    counts = df.groupBy(label, pred).count()
    long = counts.select(F.explode(F.array(*(F.lit(c) for c in classes))).alias("class_"), F.col(label).alias("y"), F.col(pred).alias("p"), "count")
    is_y, is_p = F.col("y") == F.col("class_"), F.col("p") == F.col("class_")
    n = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    out = long.groupBy("class_").agg((100 * ratio(n(is_y & is_p), n(is_y))).alias("sensitivity"), (100 * ratio(n(~is_y & ~is_p), n(~is_y))).alias("specificity"))
    return out.withColumn("bac", (F.col("sensitivity") + F.col("specificity")) / 2)


def multiclass(df: DataFrame, label: str, pred: str, classes: Sequence[str]) -> DataFrame:
    overall = df.agg((100 * F.avg((F.col(label) == F.col(pred)).cast("double"))).alias("accuracy"))
    return overall.crossJoin(one_vs_rest(df, label, pred, classes).agg(F.avg("bac").alias("mean_bac")))  # one row each


def rates(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Share of each predicted class among the rows of each true one."""
    return df.groupBy(label, pred).count().withColumn("rate", F.col("count") / F.sum("count").over(Window.partitionBy(label)))


def ratio_to_random(df: DataFrame, label: str, pred: str, n_classes: int) -> DataFrame:
    """Off-diagonal rates against those of a random decision, in percent."""
    off = F.sum(F.when(F.col(label) != F.col(pred), F.col("rate")).otherwise(0.0))
    return rates(df, label, pred).agg((100 * (1 - off / (n_classes - 1))).alias("ratio_to_random"))


def area_ratio(df: DataFrame, label: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """Area of the spider plot of a random decision's off-diagonal rates over the model's."""
    r = rates(df, label, pred)
    pairs = [(a, b) for a in classes for b in classes if a != b]
    cells = r.agg(*(F.coalesce(F.max(F.when((F.col(label) == a) & (F.col(pred) == b), F.col("rate"))), F.lit(0.0)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    n = len(pairs)
    area = sum(F.col(f"c{k}") * F.col(f"c{(k + 1) % n}") for k in range(n))
    return cells.select((n / len(classes) ** 2 / area).alias("area_ratio"))


def inverse_density_mse(df: DataFrame, label: str, pred: str) -> DataFrame:
    """MSE weighted by one over the Gaussian kernel density of the labels, Silverman's width.

    The density is summed over distinct labels, so its cost is their number squared; bin a continuous label first.
    """
    one = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    h = df.agg((1.06 * F.stddev_samp(label) * F.pow(F.count(label), -0.2)).alias("h"))
    k = one.select(F.col(label).alias("_z"), "n")
    dens = one.select(label).join(k, F.lit(True)).join(h, F.lit(True)).groupBy(label).agg(F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col(label) - F.col("_z")) / F.col("h"), 2))).alias("d"))
    w = 1 / F.col("d")
    return df.join(dens, label).agg((F.sum(w * F.pow(F.col(pred) - F.col(label), 2)) / F.sum(w)).alias("mse"))
