"""Folds, optimum choice, significance and interpretation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running
from ..functions import special, stats


def stratified_folds(df: DataFrame, row_id: str, strata: Sequence[str], k: int, seed: int | None = None, perm: int = 0, salt: int = 1) -> DataFrame:
    """Adds fold 0..k-1, even within each stratum. Order by hash of (seed, perm, id), or by id where no seed is given.

    `salt` splits large strata: rows are dealt within salted parts, which each stay even.
    """
    order = F.col(row_id) if seed is None else F.xxhash64(F.lit(seed), F.lit(perm), row_id)
    part = [F.pmod(F.xxhash64(row_id), F.lit(salt))] if salt > 1 else []
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(*strata, *part).orderBy(order, row_id)) - 1) % k)


def leave_group_out(df: DataFrame, group: str) -> DataFrame:
    g = running(df.select(group).distinct(), [], group, {"fold": ("sum", F.lit(1))}).withColumn("fold", (F.col("fold") - 1).cast("int"))
    return df.join(g, group)


def nested_folds(df: DataFrame, row_id: str, strata: Sequence[str], outer: int, inner: int) -> DataFrame:
    """fold2, and for every outer training set fold1: rows (row, fold2_test, fold1)."""
    two = stratified_folds(df, row_id, strata, outer).withColumnRenamed("fold", "fold2")
    long = two.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter("fold2 <> outer")
    return stratified_folds(long, row_id, [*strata, "outer"], inner).withColumnRenamed("fold", "fold1")


def optimum(nodes: DataFrame, worth: str, complexity: str, node: str, keys: Sequence[str] = (), lam: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """The best node after a penalty lam * complexity**gamma; least complexity, then first, among equals."""
    s = F.col(worth) - lam * F.pow(complexity, gamma)
    w = Window.partitionBy(*keys).orderBy(F.round(s, 9).desc(), complexity, node)
    return nodes.withColumn("penalised", s).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: up to 32 as it stands, from there by its series, which is exact to the last digits."""
    first = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(32).cast("long"))), F.lit(0.0), lambda a, i: a + 1 / i)
    series = F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * F.pow(n, 2)) + 1 / (120 * F.pow(n, 4)) - 1 / (252 * F.pow(n, 6))
    return F.when(n <= 32, first).otherwise(series)


def fdr(df: DataFrame, p: str, tie: str, out: str = "adjusted", dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg (or -Yekutieli) adjusted p over all rows; equal p are ranked once, by count."""
    v = stats.value_counts(df, [], p)
    m = F.col("total")
    harmonic = _harmonic(m) if dependent else F.lit(1.0)
    raw = F.col(p) * m * harmonic / F.col("cum")
    adj = running(v.withColumn("_raw", raw), [], p, {"_least": ("min", F.col("_raw"))}, descending=True).select(p, F.least(F.lit(1.0), F.col("_least")).alias(out))
    return df.join(adj, p)


def holm(df: DataFrame, p: str, tie: str, out: str = "adjusted") -> DataFrame:
    """Step-down p (m - i + 1): a running maximum, at most 1."""
    x = running(df, [], p, {"_place": ("sum", F.lit(1))}, [tie], totals={"_n": F.lit(1)}).withColumn("_raw", F.col(p) * (F.col("_n") - F.col("_place") + 1))
    return running(x, [], p, {"_most": ("max", F.col("_raw"))}, [tie]).withColumn(out, F.least(F.lit(1.0), F.col("_most"))).drop("_raw", "_place", "_n", "_most")


def fisher_combine(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Tail of chi-square with 2k degrees: exp(-x/2) times a Poisson sum."""
    s = df.groupBy(*keys).agg((-F.sum(F.ln(stats.held(F.col(p), low=1e-15)))).alias("_h"), F.count(p).alias("k"))
    term = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("k") - 1, F.lit(1).cast("long"))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * F.col("_h") / i).alias("t"), (a["s"] + a["t"] * F.col("_h") / i).alias("s")), lambda a: a["s"])
    return s.select(*keys, (2 * F.col("_h")).alias("statistic"), "k", (F.exp(-F.col("_h")) * F.when(F.col("k") > 1, term).otherwise(1.0)).alias("p"))


def stouffer(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    z = df.withColumn("_z", special.inverse_cdf(1 - F.col(p))).groupBy(*keys).agg((F.sum("_z") / F.sqrt(F.count(p))).alias("z"))
    return z.withColumn("p", 1 - special.cdf(F.col("z")))


def wilcoxon(df: DataFrame, keys: Sequence[str], d: str) -> DataFrame:
    """Signed ranks of non-zero differences: sums of positive and negative ranks, z with tie correction, p."""
    x = df.filter(F.col(d) != 0).withColumn("_a", F.abs(d))
    r = stats.tied_rank(x, keys, "_a", "_r")
    s = r.groupBy(*keys).agg(F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("minus"), F.count(F.lit(1)).alias("n"))
    ties = x.groupBy(*keys, "_a").count().groupBy(*keys).agg(F.sum(F.pow("count", 3) - F.col("count")).alias("_t"))
    s = s.join(ties, list(keys))
    n = F.col("n").cast("double")
    z = (F.col("plus") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_t") / 2) / 24)
    return s.withColumn("z", z).withColumn("p", 2 * (1 - special.cdf(F.abs("z")))).drop("_t")


def mcnemar(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(|b - c| - 1)^2 / (b + c) of two classifiers' correctness (1 or 0)."""
    x, y = F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("double")), F.sum(((F.col(a) == 0) & (F.col(b) == 1)).cast("double"))
    s = df.groupBy(*keys).agg(x.alias("b"), y.alias("c"))
    return s.withColumn("chi2", stats.ratio(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2), F.col("b") + F.col("c"))).withColumn("p", special.chi2_p(F.col("chi2"), F.lit(1.0)))


def liddell(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Exact paired test: r = b / c, F = b / (c + 1) with the larger as b."""
    m = mcnemar(df, keys, a, b)
    hi, lo = F.greatest("b", "c"), F.least("b", "c")
    return m.select(*keys, "b", "c", stats.ratio(F.col("b"), F.col("c")).alias("ratio"), F.least(F.lit(1.0), 2 * special.f_p(hi / (lo + 1), 2 * (lo + 1), 2 * hi)).alias("p"))


def block_ranks(df: DataFrame, block: str, treatment: str, value: str, quade: bool) -> DataFrame:
    """Quade's (blocks weighed by range rank) or Friedman's test: statistic, d1, d2, p."""
    r = stats.tied_rank(df, [block], value, "_r")
    t = r.select(treatment).distinct().count()
    if not quade:
        s = r.groupBy(treatment).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"))
        chi = s.agg(F.sum(F.pow("_s", 2)).alias("a"), F.max("_n").alias("n"))
        q = chi.select((12 * F.col("a") / (F.col("n") * t * (t + 1)) - 3 * F.col("n") * (t + 1)).alias("statistic"), F.lit(float(t - 1)).alias("d1"), F.lit(None).cast("double").alias("d2"))
        return q.withColumn("p", special.chi2_p(F.col("statistic"), F.col("d1")))
    span = df.groupBy(block).agg((F.max(value) - F.min(value)).alias("_w"))
    q = stats.tied_rank(span, [], "_w", "_q").select(block, "_q")
    s = r.join(q, block).withColumn("_s", F.col("_q") * (F.col("_r") - (t + 1) / 2))
    a2 = s.agg(F.sum(F.pow("_s", 2)).alias("a"), F.countDistinct(block).alias("n"))
    b = s.groupBy(treatment).agg(F.sum("_s").alias("_t")).agg(F.sum(F.pow("_t", 2)).alias("b"))
    both = a2.join(b, F.lit(True)).select((F.col("b") / F.col("n")).alias("b"), "a", "n")
    out = both.select(((F.col("n") - 1) * F.col("b") / (F.col("a") - F.col("b"))).alias("statistic"), F.lit(float(t - 1)).alias("d1"), ((t - 1) * (F.col("n") - 1)).cast("double").alias("d2"))
    return out.withColumn("p", special.f_p(F.col("statistic"), F.col("d1"), F.col("d2")))


def corrected_resampled(df: DataFrame, delta: str, k: int) -> DataFrame:
    """Repeated k-fold comparison: t with the variance widened by the share of test rows."""
    n = F.count(delta)
    t = F.avg(delta) / F.sqrt((1 / n + 1 / (k - 1)) * F.var_samp(delta))
    return df.agg(t.alias("t"), (n - 1).cast("double").alias("df")).withColumn("p", special.t_p(F.col("t"), F.col("df")))


def five_by_two(df: DataFrame, rep: str, fold: str, delta: str) -> DataFrame:
    """Sum of squared deltas over twice the summed variances: F(10, 5)."""
    r = df.groupBy(rep).agg(F.sum(F.pow(delta, 2)).alias("_q"), F.var_pop(delta).alias("_v"))
    f = r.agg((F.sum("_q") / (2 * F.sum(2 * F.col("_v")))).alias("f"))
    return f.withColumn("p", special.f_p(F.col("f"), F.lit(10.0), F.lit(5.0)))


def effect_size(auc: Column) -> Column:
    """Cohen's d of an AUC between two normal classes of equal spread."""
    return 1.4142135623730951 * special.inverse_cdf(auc)


def sign_consistency(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg((F.abs(F.avg((w > 0).cast("double")) - F.avg((w < 0).cast("double"))) * F.count(w) / F.count(F.lit(1))).alias("consistency"))


def perturb(df: DataFrame, train: DataFrame, column: str, how: str) -> DataFrame:
    """A column replaced by its training median, or by the value half the ranks away, or mirrored in rank."""
    if how == "median":
        return df.join(F.broadcast(train.agg(F.median(column).alias("_m"))), F.lit(True)).withColumn(column, F.col("_m")).drop("_m")
    v = stats.value_counts(train, [], column).select(column, (100 * (F.col("cum") - F.col("n") / 2) / F.col("total")).alias("_p"))
    target = F.col("_p") + F.when(F.col("_p") < 50, 50).otherwise(-50) if how == "flip" else 100 - F.col("_p")
    grid = stats.hazen(train, [], column, [k / 100 for k in range(101)]).agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("_g"))
    at = F.element_at("_g", (F.round(target).cast("int") + 1))["q"]
    return df.join(v, column, "left").join(F.broadcast(grid), F.lit(True)).withColumn(column, F.coalesce(at, F.col(column))).drop("_p", "_g")


def relevance(df: DataFrame, feature: str, original: str, replaced: str, span: float) -> DataFrame:
    """Median of non-zero changes in percent of a range, by feature."""
    x = 100 * (F.col(replaced) - F.col(original)) / span
    return df.withColumn("_x", x).filter("_x <> 0").groupBy(feature).agg(F.median("_x").alias("relevance"), F.stddev_samp("_x").alias("sd"), F.count(F.lit(1)).alias("n"))


def coalitions(n: int, limit: int = 4096) -> list[tuple[list[int], float]]:
    """All Kernel-SHAP subsets and weights, the smallest and largest sizes first; more than limit are refused."""
    if 2**n - 2 > limit:
        raise ValueError(f"{n} features have more than {limit} coalitions")
    out = []
    for size in sorted(range(1, n), key=lambda s: (min(s, n - s), s)):
        for c in combinations(range(n), size):
            out.append((list(c), (n - 1) / (comb(n, size) * size * (n - size))))
    return out


def diagnostics(tp: float, fp: float, fn: float, tn: float) -> dict[str, float]:
    """2x2 diagnostics."""
    n, se, sp = tp + fp + fn + tn, tp / (tp + fn), tn / (tn + fp)
    dor = tp * tn / (fp * fn)
    half = 1.96 * float(np.sqrt(1 / tp + 1 / fp + 1 / fn + 1 / tn))
    return {"sensitivity": se, "specificity": sp, "accuracy": (tp + tn) / n, "dor": dor, "dor_low": float(dor * np.exp(-half)), "dor_high": float(dor * np.exp(half)), "youden": se + sp - 1}
