"""Chains that are fitted once and applied anywhere, ensemble construction, calibration by binning, and searches.

What is fitted is a few numbers: moments, patterns of right answers with their counts, bins. It is gathered by one
aggregate, and fitting goes on in the driver over these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import exact_near, neighbours, preprocess

MOST_LEARNERS, MOST_ROWS = 12, 20_000


# --- fit once, apply anywhere


class Chain:
    """Steps that learn from training rows: each is f(train) -> (df -> df). What a step has learnt is held in the plan's literals."""

    def __init__(self, *steps: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]):
        self.steps, self.fitted = steps, None

    def fit(self, train: DataFrame) -> Chain:
        self.fitted = []
        for step in self.steps:
            apply = step(train)
            self.fitted.append(apply)
            train = apply(train)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise ValueError("fit the chain first")
        for apply in self.fitted:
            df = apply(df)
        return df


def standardising(columns: Sequence[str]) -> Callable:
    def fit(train: DataFrame):
        p = train.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        return lambda df: df.withColumns({c: (F.col(c) - p[f"m_{c}"]) / (p[f"s_{c}"] or 1.0) for c in columns})

    return fit


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without gaps: their number, means and covariances (n - 1), centred on a first pass's means."""
    ok = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    first = ok.agg(F.count(F.lit(1)), *(F.avg(f"x{i}") for i in range(len(columns)))).first()
    n, mean = first[0], np.array(first[1:], float)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = ok.agg(*(F.sum((F.col(f"x{i}") - float(mean[i])) * (F.col(f"x{j}") - float(mean[j]))) for i, j in pairs)).first()
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), s in zip(pairs, sums, strict=True):
        cov[i, j] = cov[j, i] = s / max(n - 1, 1)
    return n, mean, cov


@dataclass
class LinearMap:
    """Components as linear functions of columns: the map for rows that were not seen, too."""

    columns: Sequence[str]
    mean: np.ndarray
    weights: np.ndarray
    names: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(self.columns, self.mean, row, strict=True)), F.lit(0.0)) for n, row in zip(self.names, self.weights.T, strict=True)})


def principal_components(columns: Sequence[str], k: int, prefix: str = "pc") -> Callable:
    """A step that adds the first k components of the training rows; each has its largest weight positive."""

    def fit(train: DataFrame) -> LinearMap:
        _, mean, cov = moments(train, columns)
        value, vector = np.linalg.eigh(cov)
        w = vector[:, np.argsort(-value)[:k]]
        w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
        return LinearMap(columns, mean, w, [f"{prefix}{i + 1}" for i in range(w.shape[1])])

    return fit


def without_components_of(columns: Sequence[str], covariates: Sequence[str], least: float = 0.3) -> Callable:
    """A step that takes components out of the columns that correlate with a covariate by `least` or more (absolutely), and maps back."""

    def fit(train: DataFrame):
        p = len(columns)
        _, mean, cov = moments(train, [*columns, *covariates])
        value, vector = np.linalg.eigh(cov[:p, :p])
        cross = vector.T @ cov[:p, p:]
        r = cross / np.sqrt(np.maximum(value[:, None] * np.diag(cov)[p:], 1e-300))
        gone = vector[:, (np.abs(r) >= least).any(1) & (value > 1e-12 * value.max())]
        keep = np.eye(p) - gone @ gone.T

        def apply(df: DataFrame) -> DataFrame:
            return df.withColumns({c: sum(((F.col(b) - float(m)) * float(keep[i, j]) for j, (b, m) in enumerate(zip(columns, mean, strict=False)))) + float(mean[i]) for i, c in enumerate(columns)})

        return apply

    return fit


def line(x: str, y: str, out: str) -> Callable:
    """A step that adds the training rows' regression line."""

    def fit(train: DataFrame):
        p = train.agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i")).first()
        return lambda df: df.withColumn(out, p["i"] + p["s"] * F.col(x))

    return fit


# --- imputation


def impute_labels(df: DataFrame, key: str, vector: str, label: str, k: int = 1) -> DataFrame:
    """key, label of the rows without one: the vote of their k nearest labelled rows."""
    known = df.filter(F.col(label).isNotNull())
    near = exact_near.search_many(known, df.filter(F.col(label).isNull()), key, vector, k)
    return neighbours.majority(near, known, key, label).withColumnRenamed("q", key)


SOME = 512


def impute_sequentially(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """key and columns without gaps: cases with fewer gaps first, from their k nearest (by squared distance per known column) of the complete ones, weighted by the inverse distance; a filled case joins them.

    The order matters, so one task does it and holds the table's numbers. Each SOME cases look up what was complete before them through
    boxes, which are built anew for twice as many rows at a time, and each other one by one. A column without any value stays empty.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        x = rows[list(columns)].to_numpy(float).copy()
        gaps = np.isnan(x).sum(1)
        pool, n = np.empty_like(x), int((gaps == 0).sum())
        pool[:n] = x[gaps == 0]
        order = np.lexsort((np.arange(len(x)), gaps))
        order = order[gaps[order] > 0] if n else order[:0]
        levels, boxes = [(0, n)], {}
        for at in range(0, len(order), SOME):
            some, base = order[at : at + SOME], n
            here_of = ~np.isnan(x[some])
            far, near = np.full((len(some), k), np.inf), np.full((len(some), k), -1)
            for here in np.unique(here_of, axis=0):
                if not here.any():
                    continue
                w = np.flatnonzero((here_of == here).all(1))
                for lo, hi in levels:
                    tree = boxes.setdefault((lo, hi, here.tobytes()), None) or exact_near.Boxes(pool[lo:hi][:, here], k, "squared")
                    boxes[lo, hi, here.tobytes()] = tree
                    d, i = tree.near(x[some[w]][:, here])
                    far[w], near[w] = exact_near.merged((far[w], near[w]), (d, np.where(i < 0, -1, i + lo)), k)
            for j, i in enumerate(some):
                here = here_of[j]
                if here.any():
                    d, c = np.r_[far[j], ((pool[base:n, here] - x[i, here]) ** 2).mean(1)], np.r_[near[j], np.arange(base, n)]
                    best = np.lexsort((c, d))[:k]
                    best = best[np.isfinite(d[best])]
                    d, c = d[best], c[best]
                else:
                    c = np.arange(min(k, n))
                    d = np.ones(len(c))
                w = 1 / np.maximum(np.sqrt(d), 1e-12)
                x[i, ~here] = w @ pool[c][:, ~here] / w.sum()
                pool[n] = x[i]
                n += 1
            levels.append((base, n))
            while len(levels) > 1 and levels[-1][1] - levels[-1][0] >= levels[-2][1] - levels[-2][0]:
                levels[-2:] = [(levels[-2][0], levels[-1][1])]
            boxes = {b: t for b, t in boxes.items() if b[:2] in levels}
        rows[list(columns)] = x
        return rows

    one = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    return one.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda g: fill(g[[key, *columns]]), one.schema)


def hybrid_distance(nominal: Sequence[str], continuous: Sequence[str], a: str, b: str, low: dict[str, float], high: dict[str, float]) -> Column:
    """Mean of the share of nominal columns that differ and the mean range-scaled difference of the others; columns a_c and b_c."""
    off = sum(((F.col(f"{a}{c}") != F.col(f"{b}{c}")).cast("double") for c in nominal), F.lit(0.0)) / max(1, len(nominal))
    far = sum((F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) / (high[c] - low[c] or 1.0) for c in continuous), F.lit(0.0)) / max(1, len(continuous))
    return (off + far) / 2


# --- ensembles, from patterns of votes


def vote_patterns(df: DataFrame, learners: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the learners' outputs (a row a pattern), label sign and number of cases of each: 2 ** (learners + 1) rows at most."""
    if len(learners) > MOST_LEARNERS:
        raise ValueError(f"more than {MOST_LEARNERS} learners")
    sign = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    rows = df.dropna(subset=[*learners, label]).groupBy(*(sign(c).alias(f"h{i}") for i, c in enumerate(learners)), sign(label).alias("y")).count().collect()
    x = np.array([[r[f"h{i}"] for i in range(len(learners))] for r in rows], float).reshape(-1, len(learners))
    return x, np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float)


def boosting_weights(h: np.ndarray, y: np.ndarray, n: np.ndarray, least: float = 1e-6) -> list[float]:
    """AdaBoost's learner weights, learners in order: half the log odds of being right under the weights that the ones before leave."""
    w, out = n / n.sum(), []
    for j in range(h.shape[1]):
        wrong = h[:, j] != y
        e = float(np.clip(w[wrong].sum() / w.sum(), least, 1 - least))
        a = 0.5 * math.log((1 - e) / e)
        w = w * np.exp(np.where(wrong, a, -a))
        w /= w.sum()
        out.append(a)
    return out


def ensemble_worth(h: np.ndarray, y: np.ndarray, n: np.ndarray, members: Sequence[int], criterion: str) -> float:
    """accuracy: share right by the sum of votes (a tie is half right); entropy: mean binary entropy of votes; diversity: mean share of disagreeing pairs."""
    v = h[:, list(members)]
    if criterion == "accuracy":
        s = np.sign(v.sum(1)) * y
        return float(((s > 0) + 0.5 * (s == 0)) @ n / n.sum())
    p = (v > 0).mean(1)
    if criterion == "entropy":
        with np.errstate(divide="ignore", invalid="ignore"):
            e = -np.nan_to_num(p * np.log2(p)) - np.nan_to_num((1 - p) * np.log2(1 - p))
        return float(e @ n / n.sum())
    m = len(members)
    return float((2 * p * (1 - p) * m / max(1, m - 1)) @ n / n.sum())


def build_ensemble(h: np.ndarray, y: np.ndarray, n: np.ndarray, criterion: str = "accuracy", slack: float = 0.0) -> list[int]:
    """Backward elimination: the learner goes whose loss serves the criterion best, while accuracy stays within slack of all learners'."""
    kept = list(range(h.shape[1]))
    floor = ensemble_worth(h, y, n, kept, "accuracy") - slack
    while len(kept) > 1:
        now = ensemble_worth(h, y, n, kept, criterion)
        tries = [(ensemble_worth(h, y, n, [k for k in kept if k != c], criterion), -c) for c in kept if ensemble_worth(h, y, n, [k for k in kept if k != c], "accuracy") >= floor]
        if not tries or max(tries)[0] < now:
            break
        kept.remove(-max(tries)[1])
    return kept


# --- calibration by many binnings


def bbq(df: DataFrame, prob: str, label: str, prior: float = 2.0) -> list[tuple[float, list[float], list[float]]]:
    """Binnings of equal counts, their Bayesian weights, upper borders and means: bins from the cube root of n over 10 (2 at least) to 10 times it (100 at most).

    Cases of equal probability stay in one bin; its count of ones has a beta prior of strength `prior` in all around the bin's middle.
    """
    v = stats.value_counts(df.filter(F.col(label).isNotNull()), [], prob)
    ones = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(prob).agg(F.sum(F.col(label).cast("double")).alias("_ones"))
    n = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).count()
    root = max(n, 1) ** (1 / 3)
    sizes = range(max(2, int(root / 10)), min(100, max(2, int(root * 10))) + 1)
    both = v.join(ones, prob)
    parts = both.select(F.inline(F.array(*(F.struct(F.lit(b).alias("b"), F.floor((F.col("cum") - F.col("n") / 2) * b / F.col("total")).cast("int").alias("bin"), F.col(prob).alias("p"), F.col("n").alias("n"), F.col("_ones").alias("k")) for b in sizes))))
    rows = parts.groupBy("b", "bin").agg(F.max("p").alias("top"), F.min("p").alias("low"), F.sum("n").alias("n"), F.sum("k").alias("k")).orderBy("b", "bin").toPandas()  # 5,050 rows at most
    models = []
    for b, g in rows.groupby("b"):
        middle = np.clip((g.low + g.top).to_numpy() / 2, 1e-3, 1 - 1e-3)
        a1, a0 = prior / b * middle, prior / b * (1 - middle)
        k, m = g.k.to_numpy(float), g.n.to_numpy(float)
        lg = np.vectorize(math.lgamma)
        score = float((lg(a1 + a0) - lg(m + a1 + a0) + lg(k + a1) - lg(a1) + lg(m - k + a0) - lg(a0)).sum())
        models.append((score, g.top.tolist(), ((k + a1) / (m + a1 + a0)).tolist()))
    best = max((s for s, _, _ in models), default=0.0)
    w = np.array([math.exp(s - best) for s, _, _ in models])
    return [(float(x), top, mean) for x, (_, top, mean) in zip(w / max(w.sum(), 1e-300), models, strict=True) if x / max(w.sum(), 1e-300) > 1e-6]


def bbq_apply(df: DataFrame, prob: str, models: Sequence[tuple[float, list[float], list[float]]], out: str) -> DataFrame:
    """The weighted mean of what the binnings give; a value above the last border takes the last bin."""
    total = sum(w for w, _, _ in models)

    def one(top: list[float], mean: list[float]) -> Column:
        at = F.size(F.filter(F.array(*(F.lit(float(t)) for t in top[:-1])), lambda t: t < F.col(prob)))
        return F.get(F.array(*(F.lit(float(m)) for m in mean)), at)

    return df.withColumn(out, F.when(F.col(prob).isNotNull(), sum((w * one(top, mean) for w, top, mean in models), F.lit(0.0)) / total))


# --- searches over a grid


def anneal(worth: Callable[[tuple], float], grid: dict[str, Sequence], steps: int = 60, start: float = 1.0, cool: float = 0.93, seed: int = 0) -> tuple[tuple, float, int]:
    """Best point, its worth and how many were tried: a walk to neighbouring grid points that takes a fall of d with probability exp(-d / temperature)."""
    r, names = np.random.default_rng(seed), list(grid)
    at = [len(grid[n]) // 2 for n in names]
    seen: dict[tuple, float] = {}

    def value(i) -> float:
        point = tuple(grid[n][k] for n, k in zip(names, i, strict=True))
        if point not in seen:
            seen[point] = worth(point)
        return seen[point]

    now, heat = value(at), start
    for _ in range(steps):
        new, j = list(at), int(r.integers(len(names)))
        new[j] = int(np.clip(new[j] + r.choice([-1, 1]), 0, len(grid[names[j]]) - 1))
        v = value(new)
        if v >= now or r.random() < math.exp((v - now) / heat):
            at, now = new, v
        heat *= cool
    best = max(seen, key=lambda p: seen[p])
    return best, seen[best], len(seen)


def bayes_search(worth: Callable[[tuple], float], grid: dict[str, Sequence], first: int = 4, steps: int = 12, seed: int = 0) -> tuple[tuple, float, int]:
    """Best point, its worth and how many were tried: a Gaussian process over the grid's places picks by expected improvement."""
    names = list(grid)
    places = np.array(np.meshgrid(*(np.linspace(0, 1, len(grid[n])) if len(grid[n]) > 1 else np.zeros(1) for n in names), indexing="ij")).reshape(len(names), -1).T
    points = [tuple(grid[n][k] for n, k in zip(names, i, strict=True)) for i in np.ndindex(*(len(grid[n]) for n in names))]
    tried = list(np.random.default_rng(seed).permutation(len(points))[:first])
    y = [worth(points[i]) for i in tried]
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 0.25**2))
    for _ in range(min(steps, len(points) - len(tried))):
        x, z = places[tried], np.array(y)
        mean, sd = z.mean(), z.std() or 1.0
        k = np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
        s = kernel(places, x)
        mu, var = s @ k @ ((z - mean) / sd), np.maximum(1 - np.einsum("ij,jk,ik->i", s, k, s), 1e-12)
        gain = mu - (max(z) - mean) / sd
        u = gain / np.sqrt(var)
        phi = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
        better = gain * np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in u]) + np.sqrt(var) * phi
        better[tried] = -1
        tried.append(int(better.argmax()))
        y.append(worth(points[tried[-1]]))
    best = int(np.argmax(y))
    return points[tried[best]], float(y[best]), len(tried)


def explained(df: DataFrame, columns: Sequence[str], target: str) -> Callable[[Sequence[str]], float]:
    """R squared of the target on any of the columns, from one pass over the rows: a worth for wrapper searches."""
    _, _, cov = moments(df, [*columns, target])
    at = {c: i for i, c in enumerate(columns)}

    def worth(chosen: Sequence[str]) -> float:
        i = [at[c] for c in chosen]
        return float(cov[i, -1] @ np.linalg.pinv(cov[np.ix_(i, i)]) @ cov[i, -1] / cov[-1, -1])

    return worth


def external_weights(df: DataFrame, keys: Sequence[str], features: Sequence[str], weights: DataFrame, feature: str, weight: str) -> DataFrame:
    """Keys, feature, value times the user's weight; features without one are left out."""
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias(feature), F.col(f).cast("double").alias("value")) for f in features))))
    return preprocess.with_parameters(long, weights.select(feature, F.col(weight).alias("_w")), [feature]).filter("_w is not null").withColumn("value", F.col("value") * F.col("_w")).drop("_w")
