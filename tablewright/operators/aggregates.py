"""Grouped statistics that need more than one aggregate, and windowed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import written


def value_table(df: DataFrame, value: str) -> DataFrame:
    """value, n, percent of all rows with a value."""
    one = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def unique_counts(df: DataFrame, columns: Sequence[str], threshold: float = 90.0) -> DataFrame:
    """feature, n_unique, top_percent, flagged: whether one value makes up `threshold` percent or more."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "feature", "value").filter("value is not null")
    counts = long.groupBy("feature", "value").count()
    out = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), (100 * F.max("count") / F.sum("count")).alias("top_percent"))
    return out.withColumn("flagged", F.col("top_percent") >= threshold)


def quality_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, missing, mean, sd, constant in one pass over the rows."""
    rows = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("missing"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("sd"), (F.min(c) == F.max(c)).alias("constant")) for c in columns]
    return df.agg(F.array(*rows).alias("_a")).select(F.inline("_a"))


def quantile_split(df: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """Adds bin (1..parts) by Hazen borders of each group."""
    b = stats.hazen(df, keys, value, [k / parts for k in range(1, parts)]).groupBy(*keys).agg(F.sort_array(F.collect_list("q")).alias("_b"))
    x = df.join(b, list(keys)) if keys else df.join(F.broadcast(b), F.lit(True))
    return x.withColumn("bin", F.lit(1) + F.size(F.filter("_b", lambda q: q <= F.col(value)))).drop("_b")


def percentile_rank(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """point, percentile: 100 (n_less + half of n_equal) / n."""
    x = F.col(value)
    rows = [F.struct(F.lit(float(p)).alias("point"), (100 * (F.sum((x < p).cast("double")) + 0.5 * F.sum((x == p).cast("double"))) / F.count(x)).alias("percentile")) for p in points]
    return df.agg(F.array(*rows).alias("_a")).select(F.inline("_a"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r over the rows that have both, for all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"), F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("_a")).select(F.inline("_a"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = stats.tied_rank(stats.tied_rank(both, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"))


def biweight(df: DataFrame, keys: Sequence[str], a: str, b: str, c: float = 9.0) -> DataFrame:
    """Biweight midcorrelation: weights (1 - u^2)^2 from distances to the median in units of c MAD."""
    def medians(rows: DataFrame, of: dict[str, str], name: str) -> DataFrame:
        """A row for each group, written: what is built on it does not repeat its plan."""
        one, two = (stats.hazen(rows, keys, c, [0.5]).select(*keys, F.col("q").alias(out)) for out, c in of.items())
        found = written(one.join(two, list(keys)) if keys else one.join(F.broadcast(two), F.lit(True)), name)
        return rows.join(found, list(keys)) if keys else rows.join(F.broadcast(found), F.lit(True))

    df = medians(df, {f"_m_{col}": col for col in (a, b)}, "medians")
    df = df.withColumns({f"_d_{col}": F.abs(F.col(col) - F.col(f"_m_{col}")) for col in (a, b)})
    df = medians(df, {f"_s_{col}": f"_d_{col}" for col in (a, b)}, "deviations")
    z = {}
    for col in (a, b):
        x = F.col(col) - F.col(f"_m_{col}")
        u = x / (c * F.col(f"_s_{col}"))
        z[col] = x * F.when(F.abs(u) < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
    return df.groupBy(*keys).agg((F.sum(z[a] * z[b]) / F.sqrt(F.sum(z[a] * z[a]) * F.sum(z[b] * z[b]))).alias("r"))


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bits of a discrete column."""
    p = df.groupBy(*keys, value).count().withColumn("_p", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """mi and conditional entropy h_x_given_y, in bits, from the contingency table."""
    t = df.groupBy(x, y).count()
    every = Window.partitionBy()
    t = t.withColumns({"_p": F.col("count") / F.sum("count").over(every), "_x": F.sum("count").over(Window.partitionBy(x)) / F.sum("count").over(every), "_y": F.sum("count").over(Window.partitionBy(y)) / F.sum("count").over(every)})
    p = F.col("_p")
    return t.agg(F.sum(p * F.log2(p / (F.col("_x") * F.col("_y")))).alias("mi"), (-F.sum(p * F.log2(p / F.col("_y")))).alias("h_x_given_y"))


def cv_ratio(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over the standard error, with the population variance."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) / (F.stddev_pop(value) / F.sqrt(F.count(value)))).alias("ratio"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the weight reaches half."""
    one = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    cum = one.withColumns({"_c": F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_w").over(w)})
    return cum.filter(2 * F.col("_c") >= F.col("_t")).groupBy(*keys).agg(F.min(value).alias("median"))


def majority(df: DataFrame, keys: Sequence[str], vote: str) -> DataFrame:
    """The class of most votes (the smallest of equals), its share, and whether there was a tie."""
    one = df.groupBy(*keys, vote).count()
    w = Window.partitionBy(*keys)
    top = one.withColumns({"share": F.col("count") / F.sum("count").over(w), "_r": F.row_number().over(w.orderBy(F.col("count").desc(), vote)), "_k": F.rank().over(w.orderBy(F.col("count").desc()))})
    top = top.withColumn("tie", F.sum((F.col("_k") == 1).cast("int")).over(w) > 1)
    return top.filter("_r = 1").select(*keys, vote, "share", "tie")


def moving_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int, out: str) -> DataFrame:
    """Centred mean over an odd number of rows, fewer at the edges."""
    h = window // 2
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-h, h)))


def sliding_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, x: str, window: int) -> DataFrame:
    """Flags among this row and the `window` after it, over window, and the mean of x there; full windows only."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, window)
    return df.withColumns({"rate": F.sum(flag).over(w) / window, "mean_x": F.avg(x).over(w), "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_n") == window + 1).drop("_n")


def detrended(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    line = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return df.join(line, list(keys)).withColumn(out, F.col(y) - (F.col("_s") * F.col(x) + F.col("_i"))).drop("_s", "_i")


def leading(df: DataFrame, keys: Sequence[str], order: Sequence, weight: str, energy: float) -> DataFrame:
    """The first rows that together reach a share of the group's weight."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({"_b": before, "_t": F.sum(weight).over(w)}).filter(F.col("_b") < energy * F.col("_t")).drop("_b", "_t")
