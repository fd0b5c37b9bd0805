"""Parameter search and synthetic cases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special, stats
from ..sources.shared import written
from .neighbours import numbered, search
from .numeric import moments


def grid_search(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], mixes: Sequence[float], folds: int = 3) -> DataFrame:
    """penalty, mix, auc over folds, for every node of the grid."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    lr = LogisticRegression(labelCol=label, maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).addGrid(lr.elasticNetParam, list(mixes)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=1, parallelism=4).fit(data)
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(a)) for g, a in zip(grid, cv.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "penalty double, mix double, auc double")


def scenarios(spark: SparkSession, sizes: Sequence[int], prevalences: Sequence[float], effects: Sequence[float]) -> DataFrame:
    df = spark.range(1)
    for name, vs in (("n", sizes), ("prevalence", prevalences), ("effect", effects)):
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in vs))))
    return df.drop("id")


def performance(grid: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """Expected balanced accuracy of a nearest-mean rule in each scenario; a scenario's repetitions are rows of their own tasks."""

    def one(batches):
        for p in batches:
            out = []
            for r in p.itertuples():
                g = np.random.default_rng([seed, int(r.n), int(1000 * r.prevalence), int(1000 * r.effect), int(r.repeat)])
                y = g.random(int(r.n)) < r.prevalence
                x = g.normal(size=int(r.n)) + r.effect * y
                half = np.arange(len(y)) % 2 == 0
                if y[half].all() or not y[half].any():
                    out.append(0.5)
                    continue
                cut = (x[half & y].mean() + x[half & ~y].mean()) / 2
                says = x[~half] > cut
                rates = [(says == y[~half])[y[~half] == k].mean() for k in (True, False) if (y[~half] == k).any()]
                out.append(float(np.mean(rates)))
            yield p.assign(bac=out)

    rows = grid.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(one, f"{fields}, bac double").groupBy("n", "prevalence", "effect").agg(F.round(F.avg("bac"), 6).alias("bac"), F.round(F.stddev_samp("bac"), 6).alias("sd"))


def copula(df: DataFrame, columns: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """New cases with the columns' own distributions and rank correlations, both of all complete rows."""
    rows = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna(), "complete-rows")
    total, score, scored = rows.count(), F.pandas_udf(lambda u: u.map(special.normal_inverse).astype(float), "double"), rows
    for i, c in enumerate(columns):
        ranks = stats.tied_rank(rows.select(c), [], c, "_r").distinct()
        scored = scored.join(ranks.select(c, score((F.col("_r") - 0.5) / total).alias(f"_z{i}")), c)
    cov = moments(scored, [f"_z{i}" for i in range(len(columns))])[0]["cov"]
    sd = np.sqrt(np.diag(cov))
    g = np.random.default_rng(seed).multivariate_normal(np.zeros(len(columns)), cov / np.outer(sd, sd), n)
    u = np.vectorize(special.normal_cdf)(g)
    new = {}
    for i, c in enumerate(columns):
        at = dict(tuple(r) for r in stats.hazen(rows, [], c, u[:, i].tolist()).collect())
        new[c] = [float(at[p]) for p in u[:, i].tolist()]
    return df.sparkSession.createDataFrame(pd.DataFrame(new))


def between_neighbours(df: DataFrame, columns: Sequence[str], n: int, k: int = 5, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """New cases on the way from a case to one of its k nearest, both among all complete rows; at most QUERY_LIMIT cases are started from."""
    rows, cols = numbered(df.select(*columns)), list(columns)
    p = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols))).first()
    r = np.random.default_rng(seed)
    start = r.integers(0, p["n"], n).tolist()
    z = rows.select("_id", F.array(*((F.col(c) - float(p[f"m{i}"])) / max(float(p[f"s{i}"]), 1e-12) for i, c in enumerate(cols))).alias("_z"))
    picked = df.sparkSession.createDataFrame([(i,) for i in sorted(set(start))], "_id long")
    near = search(z, z.join(F.broadcast(picked), "_id", "left_semi"), "_id", "_z", k, metric).select("q", "d", F.col("b").alias("_id"))
    found: dict[int, list] = {}
    for x in near.join(rows, "_id").orderBy("q", "d", "_id").collect():
        found.setdefault(x["q"], []).append(np.array([x[c] for c in cols], float))
    own = {x["_id"]: np.array([x[c] for c in cols], float) for x in rows.join(F.broadcast(picked), "_id", "left_semi").collect()}
    out = [own[i] + r.random() * (found[i][r.integers(len(found[i]))] - own[i]) for i in start]
    return df.sparkSession.createDataFrame(pd.DataFrame(np.array(out), columns=cols))
