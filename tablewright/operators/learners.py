"""Learners: one registry of estimators that Spark ships, and a few solved per fold in numpy.

`fit(name, df, features, label)` returns a function of a DataFrame that adds `prediction` (and `score`, where there is one).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSIFIERS: dict[str, Callable] = {
    "linear_svm": lambda **k: mc.LinearSVC(maxIter=20, **k), "logistic": lambda **k: mc.LogisticRegression(maxIter=30, **k), "elastic_net": lambda **k: mc.LogisticRegression(maxIter=30, regParam=0.01, elasticNetParam=0.5, **k),
    "tree": lambda **k: mc.DecisionTreeClassifier(maxDepth=5, seed=1, **k), "forest": lambda **k: mc.RandomForestClassifier(numTrees=10, maxDepth=5, seed=1, **k), "boosting": lambda **k: mc.GBTClassifier(maxIter=5, maxDepth=3, seed=1, **k), "naive_bayes": lambda **k: mc.NaiveBayes(modelType="gaussian", **k),
}
REGRESSORS: dict[str, Callable] = {
    "linear": lambda **k: mr.LinearRegression(**k), "lasso": lambda **k: mr.LinearRegression(regParam=0.1, elasticNetParam=1.0, **k), "glm": lambda **k: mr.GeneralizedLinearRegression(family="gaussian", **k),
    "tree": lambda **k: mr.DecisionTreeRegressor(maxDepth=5, seed=1, **k), "forest": lambda **k: mr.RandomForestRegressor(numTrees=10, maxDepth=5, seed=1, **k), "boosting": lambda **k: mr.GBTRegressor(maxIter=5, maxDepth=3, seed=1, **k),
}


def fit(name: str, df: DataFrame, features: Sequence[str], label: str, regression: bool = False):
    """Rows with a missing value are not learnt from, and get no prediction."""
    build = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip")
    model = (REGRESSORS if regression else CLASSIFIERS)[name](featuresCol="_f", labelCol=label).fit(build.transform(df.dropna(subset=[label])))

    def apply(x: DataFrame) -> DataFrame:
        out = model.transform(build.transform(x))
        if "rawPrediction" in out.columns:
            out = out.withColumn("score", vector_to_array("rawPrediction")[1])
        return out.drop("_f", "rawPrediction", "probability")

    return apply


def perceptron(df: DataFrame, features: Sequence[str], label: str, hidden: int = 8, classes: int = 2):
    build = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip")
    model = mc.MultilayerPerceptronClassifier(layers=[len(features), hidden, classes], featuresCol="_f", labelCol=label, seed=1, maxIter=30).fit(build.transform(df))
    return lambda x: model.transform(build.transform(x)).drop("_f", "rawPrediction", "probability")


def survival(df: DataFrame, features: Sequence[str], time: str, event: str):
    """Weibull accelerated failure time; adds the predicted time, and survival(t) = exp(-(t / scale)^shape)."""
    build = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip")
    model = mr.AFTSurvivalRegression(featuresCol="_f", labelCol=time, censorCol=event).fit(build.transform(df))
    shape = 1 / model.scale

    def apply(x: DataFrame) -> DataFrame:
        out = model.transform(build.transform(x)).drop("_f")
        h = F.pow(F.col(time) / F.col("prediction"), shape)
        return out.withColumns({"survival": F.exp(-h), "hazard": shape / F.col(time) * h})

    return apply


def mixture(df: DataFrame, features: Sequence[str], k: int, seed: int = 1):
    build = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip")
    model = GaussianMixture(featuresCol="_f", k=k, seed=seed).fit(build.transform(df))
    return lambda x: model.transform(build.transform(x)).drop("_f", "probability")


def kernel_ridge(x: np.ndarray, y: np.ndarray, gamma: float, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.linalg.solve(k + ridge * np.eye(len(x)), y)
    return lambda z: np.exp(-gamma * ((z[:, None] - x[None]) ** 2).sum(-1)) @ a


def extreme_learning(x: np.ndarray, y: np.ndarray, hidden: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    r = np.random.default_rng(seed)
    w, b = r.normal(size=(x.shape[1], hidden)), r.normal(size=hidden)
    beta = np.linalg.pinv(np.tanh(x @ w + b)) @ y
    return lambda z: np.tanh(z @ w + b) @ beta


def bayes_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Callable[[np.ndarray], np.ndarray]:
    """Evidence-maximising ridge."""
    x1 = np.column_stack([np.ones(len(x)), x])
    a, b = 1.0, 1 / max(y.var(), 1e-12)
    for _ in range(rounds):
        s = np.linalg.inv(a * np.eye(x1.shape[1]) + b * x1.T @ x1)
        m = b * s @ x1.T @ y
        g = x1.shape[1] - a * np.trace(s)
        a, b = g / max(m @ m, 1e-12), (len(y) - g) / max(((y - x1 @ m) ** 2).sum(), 1e-12)
    return lambda z: np.column_stack([np.ones(len(z)), z]) @ m


SMALL: dict[str, Callable] = {"kernel": lambda x, y: kernel_ridge(x, y, 0.5, 0.1), "extreme_learning": lambda x, y: extreme_learning(x, y, 40, 1), "bayes_ridge": bayes_ridge}


def train_folds(df: DataFrame, row_id: str, features: Sequence[str], label: str, fold: str, learners: Sequence[str], per_fold: int = 1500, seed: int = 0) -> DataFrame:
    """row_id, fold, learner, prediction: every fold and learner is one task, trained on at most `per_fold` rows outside the fold (by hash), scoring all rows in it.

    The training rows are that documented sample; test rows are streamed past them in batches.
    """
    n = df.select(fold).distinct().count()
    picked = df.withColumn("_h", F.xxhash64(F.lit(seed), row_id)).withColumn("_r", F.row_number().over(Window.partitionBy(fold).orderBy("_h", row_id))).filter(F.col("_r") <= -(-per_fold // max(n - 1, 1)))
    rows = picked.select(fold, label, *features).dropna().collect()  # per_fold * folds / (folds - 1) rows at most
    pool, cols = pd.DataFrame([tuple(r) for r in rows], columns=["_fold", "_y", *features]).astype({c: float for c in ["_y", *features]}), list(features)
    mean, sd = pool[cols].mean().to_numpy(), np.maximum(pool[cols].std().to_numpy(), 1e-9)

    def each(batches):
        models: dict = {}
        for p in batches:
            for f, part in p.groupby("_fold"):
                z = (part[cols].to_numpy(float) - mean) / sd
                for name in learners:
                    if (f, name) not in models:
                        t = pool[pool["_fold"] != f]
                        models[f, name] = SMALL[name]((t[cols].to_numpy() - mean) / sd, t["_y"].to_numpy())
                    yield pd.DataFrame({"row_id": part["_id"], "fold": f, "learner": name, "prediction": models[f, name](z)})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (row_id, fold)}
    return df.select(F.col(row_id).alias("_id"), F.col(fold).alias("_fold"), *features).dropna().mapInPandas(each, f"row_id {kinds[row_id]}, fold {kinds[fold]}, learner string, prediction double")


def sequential(df: DataFrame, scores: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Cases whose score lies between two percentiles move on to the next score; adds score and stage."""
    cuts = df.agg(*(F.percentile_approx(s, [low, high], 10000).alias(f"_c{i}") for i, s in enumerate(scores)))
    x = df.join(F.broadcast(cuts), F.lit(True))
    score, stage = F.col(scores[-1]), F.lit(len(scores))
    for i in range(len(scores) - 2, -1, -1):
        sure = (F.col(scores[i]) < F.col(f"_c{i}")[0]) | (F.col(scores[i]) > F.col(f"_c{i}")[1])
        score, stage = F.when(sure, F.col(scores[i])).otherwise(score), F.when(sure, i + 1).otherwise(stage)
    return x.withColumns({"score": score, "stage": stage}).drop(*cuts.columns)


def policy_value(df: DataFrame, treatment: str, outcome: str, propensity: str, predicted: str, given: str = "given") -> DataFrame:
    """Doubly robust mean outcome of each treatment: prediction plus the inverse-propensity-weighted residual; one row for each case and treatment that has a prediction."""
    return df.groupBy(treatment).agg(F.avg(F.col(predicted) + F.when(F.col(given) == F.col(treatment), (F.col(outcome) - F.col(predicted)) / F.greatest(propensity, F.lit(0.01))).otherwise(0.0)).alias("value"))
