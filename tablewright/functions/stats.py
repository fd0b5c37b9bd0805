"""Column expressions and grouped statistics: missing values, Hazen percentiles, ranks, correlations.

Missing is NULL; `known` turns NaN into it at the edge. Order statistics first count equal values, so a group of many ties
costs no more than one of few; distinct values are then ordered in buckets (order.py), so that no task sees all of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def known(c: Column | str) -> Column:
    """NULL for NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def held(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held to a range; missing stays missing, which least and greatest alone would turn into a bound."""
    y = x if high is None else F.least(F.lit(high), x)
    return F.when(x.isNotNull(), y if low is None else F.greatest(F.lit(low), y))


def weighted_mean(x: Column, w: Column) -> Column:
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def plus(a: Column, b: Column) -> Column:
    """Sum that skips a missing side."""
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def skew_sample_sd(x: Column) -> Column:
    """Third central moment (n) over the cube of the sample SD (n - 1)."""
    n = F.count(x)
    return F.skewness(x) * F.pow(F.var_pop(x), 1.5) / F.pow(F.stddev_samp(x), 3) * F.when(n > 1, 1)


def softmax(x: Column, over: Sequence[str], sharpness: float = 3.0) -> Column:
    e = F.exp(sharpness * x)
    return e / F.sum(e).over(Window.partitionBy(*over))


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, 2)) / (sd * 2.5066282746310002)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with count n, cumulative count cum, and group size total."""
    one = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running(one, keys, value, {"cum": ("sum", F.col("n"))}, totals={"total": F.col("n")})


def hazen(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """keys, p, q: percentiles at plotting positions (i - 0.5) / n, linear between neighbours, held to the range."""
    v = value_counts(df, keys, value)
    out = []
    for p in probs:
        pos = F.greatest(F.lit(1.0), F.least(F.col("total").cast("double"), F.col("total") * p + 0.5))
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("total"))
        out.append(F.struct(F.lit(float(p)).alias("p"), F.min(F.when(F.col("cum") >= lo, F.col(value))).alias("a"), F.min(F.when(F.col("cum") >= hi, F.col(value))).alias("b"), F.max(pos - lo).alias("f")))
    rows = v.groupBy(*keys).agg(F.array(*out).alias("_q")).select(*keys, F.inline("_q"))
    return rows.select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q"))


def tied_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "r") -> DataFrame:
    """Adds average ranks; rows join their value's rank, so ties are ranked once."""
    v = value_counts(df, keys, value).select(*keys, value, (F.col("cum") - (F.col("n") - 1) / 2).alias(out))
    return df.join(v, [*keys, value], "left")


def auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """keys, auc: positive labels against negative ones, ties half; from distinct scores."""
    one = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & (F.col(label) != 0)).groupBy(*keys, score).agg(F.sum((F.col(label) > 0).cast("long")).alias("_p"), F.sum((F.col(label) < 0).cast("long")).alias("_m"))
    won = running(one, keys, score, {"_upto": ("sum", F.col("_m"))}).withColumn("won", F.col("_p") * (F.col("_upto") - F.col("_m") / 2))
    return won.groupBy(*keys).agg(ratio(F.sum("won"), F.sum("_p") * F.sum("_m")).alias("auc"))
