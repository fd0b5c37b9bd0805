"""Feature weights: feature, weight. Filters take one aggregate over all columns; greedy ones loop over small contingency tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special, stats
from .neighbours import numbered, search


def _rows(df: DataFrame, columns: Sequence[str], weight, name: str = "weight") -> DataFrame:
    return df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), weight(F.col(c)).alias(name)) for c in columns)).alias("_a")).select(F.inline("_a"))


def variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _rows(df, columns, F.var_samp)


def fscore(df: DataFrame, columns: Sequence[str], label: str, sample: bool = False) -> DataFrame:
    """(mean1 - mean0)^2 over the sum of the classes' SDs, population ones unless `sample`; label 1 or 0."""
    sd = F.stddev_samp if sample else F.stddev_pop
    own = lambda x, k: F.when(F.col(label) == k, x)
    return _rows(df, columns, lambda x: F.pow(F.avg(own(x, 1)) - F.avg(own(x, 0)), 2) / (sd(own(x, 1)) + sd(own(x, 0))))


def pearson(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    return _rows(df, columns, lambda x: F.abs(F.corr(x, F.col(label))))


def anova(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, f, p, r2 over any number of classes."""
    long = df.select(label, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(label, list(columns), "feature", "x").dropna()
    g = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")
    g = g.withColumn("_all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_all"), 2)).alias("_b"), F.sum(F.col("n") * F.col("v")).alias("_e"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    d1, d2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = (F.col("_b") / d1) / (F.col("_e") / d2)
    return s.select("feature", f.alias("f"), special.f_p(f, d1.cast("double"), d2.cast("double")).alias("p"), (F.col("_b") / (F.col("_b") + F.col("_e"))).alias("r2"))


def auc(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    long = df.select(F.when(F.col(label) == 1, 1).otherwise(-1).alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot("_y", list(columns), "feature", "x")
    return stats.auc(long, ["feature"], "_y", "x").withColumnRenamed("auc", "weight")


def binned(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of every column, beside the label; a missing value counts in the last bin, a constant in the first."""
    p = df.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))

    def one(c: str) -> Column:
        span = F.nullif((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).cast("double"), F.lit(0.0))
        return F.coalesce(F.least(F.floor((F.col(c) - F.col(f"_lo_{c}")) / span * bins), F.lit(bins - 1)), F.lit(0))

    return df.join(F.broadcast(p), F.lit(True)).select(F.col(label).alias("_y"), *(one(c).alias(c) for c in columns))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    t = binned(df, columns, label, bins).unpivot("_y", list(columns), "feature", "b").groupBy("feature", "b", "_y").count()
    w = lambda *k: Window.partitionBy("feature", *k)
    p, px, py = (F.sum("count").over(w(*k)) / F.sum("count").over(w()) for k in (("b", "_y"), ("b",), ("_y",)))
    return t.withColumns({"_p": p, "_x": px, "_q": py}).groupBy("feature").agg(F.sum(F.col("_p") * F.log2(F.col("_p") / (F.col("_x") * F.col("_q")))).alias("weight"))


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def greedy(df: DataFrame, columns: Sequence[str], label: str, criterion: str, bins: int = 10) -> DataFrame:
    """Forward selection by an information criterion (mrmr, jmi, cmim, disr, icap, fcbf); feature, place, weight.

    All pair-by-label tables come from one grouped count (bins^2 x classes cells for each pair); the loop runs on those.
    """
    b = binned(df, columns, label, bins)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    long = b.select("_y", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(columns[i]).alias("x"), F.col(columns[j]).alias("z")) for k, (i, j) in enumerate(pairs)))).alias("s")).select("_y", "s.*")
    kinds: dict = {}
    cube = np.zeros((len(pairs), bins, bins, 64))
    for r in long.groupBy("k", "x", "z", "_y").count().collect():
        cube[r["k"], r["x"], r["z"], kinds.setdefault(r["_y"], len(kinds))] += r["count"]
    cube = cube[..., : max(len(kinds), 1)]
    at = {p: k for k, p in enumerate(pairs)}
    n = len(columns)
    mi, red, joint, cond, h_joint, h = np.zeros(n), np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n)), np.ones((n, n)), np.zeros(n)
    hy = _entropy(cube[0].sum((0, 1)))
    for i in range(n):
        own = cube[at[i, i]].sum(1)
        h[i] = _entropy(own.sum(1))
        mi[i] = h[i] + hy - _entropy(own.ravel())
    for i, j in pairs:
        c = cube[at[i, j]]
        hij, hijy = _entropy(c.sum(2).ravel()), _entropy(c.ravel())
        red[i, j] = red[j, i] = h[i] + h[j] - hij
        joint[i, j] = joint[j, i] = hij + hy - hijy
        h_joint[i, j] = h_joint[j, i] = max(hijy, 1e-12)
        cond[i, j], cond[j, i] = joint[i, j] - mi[j], joint[i, j] - mi[i]
    left, chosen = list(range(n)), []

    def worth(i: int) -> float:
        if not chosen:
            return float(mi[i])
        s = np.array([j for j, _ in chosen])
        return float({
            "mrmr": lambda: mi[i] - red[i, s].mean(), "jmi": lambda: joint[i, s].sum(), "cmim": lambda: min(mi[i], cond[i, s].min()), "disr": lambda: (joint[i, s] / h_joint[i, s]).sum(),
            "icap": lambda: mi[i] - np.maximum(0, red[i, s] - (cond[i, s] - mi[i] + red[i, s])).sum(), "fcbf": lambda: 2 * mi[i] / max(h[i] + hy, 1e-12) if all(2 * red[i, j] / max(h[i] + h[j], 1e-12) < 2 * mi[i] / max(h[i] + hy, 1e-12) for j in s) else 0.0,
        }[criterion]())

    while left:
        best = max(left, key=lambda i: (worth(i), -i))
        chosen.append((best, worth(best)))
        left.remove(best)
    return df.sparkSession.createDataFrame([(columns[i], k + 1, w) for k, (i, w) in enumerate(chosen)], "feature string, place int, weight double")


def relief(df: DataFrame, columns: Sequence[str], label: str, k: int = 10, cases: int = 500, seed: int = 0) -> DataFrame:
    """ReliefF weights: `cases` drawn rows (the method's own number of updates) meet all complete rows, their k nearest of each class by scaled cityblock distance.

    A feature gains by differing from other classes, weighed by their share, and loses by differing within the class. A constant weighs 0.
    """
    cols = [f"x{i}" for i in range(len(columns))]
    rows = numbered(df.select(F.col(label).alias("y"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, cols, strict=True))))
    span = rows.agg(*(F.min(c).alias(f"lo_{c}") for c in cols), *(F.max(c).alias(f"hi_{c}") for c in cols)).first()
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total, r = sum(size.values()), np.random.default_rng(seed)
    if not total:
        return df.sparkSession.createDataFrame([], "feature string, weight double")
    picked = df.sparkSession.createDataFrame([(int(i),) for i in r.choice(total, min(cases, total), replace=False)], "_id long")
    scaled = rows.select("_id", "y", F.array(*((F.col(c) - span[f"lo_{c}"]) / max(span[f"hi_{c}"] - span[f"lo_{c}"], 1e-12) for c in cols)).alias("v"))
    own = scaled.join(F.broadcast(picked), "_id", "left_semi")
    near = reduce(DataFrame.unionByName, [search(scaled.filter(F.col("y") == F.lit(c)), own, "_id", "v", k, "cityblock").withColumn("c", F.lit(c)) for c in size])
    share = F.create_map(*(F.lit(x) for c, n in size.items() for x in (c, n / total)))
    met = near.join(own.select(F.col("_id").alias("q"), F.col("v").alias("w"), F.col("y").alias("yq")), "q").join(scaled.select(F.col("_id").alias("b"), "v"), "b")
    far = F.posexplode(F.zip_with("v", "w", lambda a, b: F.abs(a - b)))
    mean = met.select("q", "yq", "c", far.alias("i", "d")).groupBy("q", "yq", "c", "i").agg(F.avg("d").alias("d"))
    worth = F.when(F.col("c") == F.col("yq"), -1.0).otherwise(share[F.col("c")] / (1 - share[F.col("yq")]))
    names = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (i, c)))
    return mean.groupBy("i").agg((F.sum(F.col("d") * worth) / min(cases, total)).alias("weight")).select(names[F.col("i")].alias("feature"), "weight")


def linear_svm(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """|w| of a linear SVM on standardised columns."""
    m = LinearSVC(featuresCol="_f", labelCol=label, maxIter=20).fit(VectorAssembler(inputCols=list(columns), outputCol="_f").transform(df))
    sd = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    return df.sparkSession.createDataFrame([(c, float(abs(v) * (sd[c] or 0))) for c, v in zip(columns, m.coefficients, strict=True)], "feature string, weight double")


def rescale(weights: DataFrame, invert: bool = False) -> DataFrame:
    """Absolute weights scaled to 0..1 over all features."""
    a, w = F.abs("weight"), Window.partitionBy()
    s = (a - F.min(a).over(w)) / F.nullif(F.max(a).over(w) - F.min(a).over(w), F.lit(0.0))
    return weights.withColumn("weight", 1 - s if invert else s)


def subsets(weights: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """subset, feature: the best features for each size."""
    r = weights.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("weight"), "feature")))
    return r.withColumn("subset", F.explode(F.array(*(F.lit(s) for s in sizes)))).filter("_r <= subset").select("subset", "feature")


def forward(columns: Sequence[str], worth, stop: int | None = None) -> list[tuple[str, float]]:
    """Greedy forward search by worth(list of columns), a driver loop over fitted models."""
    chosen, left, out = [], list(columns), []
    while left and len(chosen) < (stop or len(columns)):
        scored = [(worth([*chosen, c]), c) for c in left]
        best, c = max(scored, key=lambda s: s[0])
        if out and best <= out[-1][1]:
            break
        chosen.append(c)
        left.remove(c)
        out.append((c, float(best)))
    return out


def backward(columns: Sequence[str], worth) -> list[str]:
    """Greedy backward search: a column goes while worth does not fall."""
    kept, now = list(columns), worth(list(columns))
    while len(kept) > 1:
        best, c = max((worth([k for k in kept if k != c]), c) for c in kept)
        if best < now:
            break
        kept.remove(c)
        now = best
    return kept


def pandas_weights(df: DataFrame, f, columns: Sequence[str], label: str, limit: int = 100_000) -> DataFrame:
    """Weights by a user function of a pandas frame of all complete rows; more than `limit` are refused."""
    pdf: pd.DataFrame = df.select(label, *columns).dropna().limit(limit + 1).toPandas()
    if len(pdf) > limit:
        raise ValueError(f"more than {limit} complete rows: give a sample")
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, f(pdf), strict=True)], "feature string, weight double")
