"""Combining learners and decoding several classes. Votes are long: case, learner (or code position), vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def decide(votes: DataFrame, case: str, vote: str) -> DataFrame:
    """Mean vote and its sign; a tie goes to the positive class, by rule."""
    m = F.avg(vote)
    return votes.groupBy(case).agg(m.alias("score"), F.when(m >= 0, 1).otherwise(-1).alias("decision"))


def vote_entropy(votes: DataFrame, case: str, vote: str, n_classes: int) -> DataFrame:
    """Mean over cases of the votes' entropy in bits, over log2 of the number of classes."""
    p = votes.groupBy(case, vote).count().withColumn("_p", F.col("count") / F.sum("count").over(Window.partitionBy(case)))
    return p.groupBy(case).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("_h")).agg((F.avg("_h") / F.log2(F.lit(float(n_classes)))).alias("entropy"))


def ambiguity(votes: DataFrame, case: str, vote: str) -> DataFrame:
    """Mean natural entropy of non-zero votes."""
    p = votes.filter(F.col(vote) != 0).groupBy(case, vote).count().withColumn("_p", F.col("count") / F.sum("count").over(Window.partitionBy(case)))
    return p.groupBy(case).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("_h")).agg(F.avg("_h").alias("ambiguity"))


def regression_ambiguity(preds: DataFrame, case: str, pred: str) -> DataFrame:
    return preds.groupBy(case).agg(F.var_pop(pred).alias("_v")).agg(F.avg("_v").alias("ambiguity"))


def pair_diversity(votes: DataFrame, case: str, learner: str, correct: str) -> DataFrame:
    """q and double_fault over pairs of learners; every cell of a pair's table carries 0.5 more. correct: 1 or 0.

    Learners are few: their pairs are formed within a case, from its list of votes.
    """
    one = votes.groupBy(case).agg(F.sort_array(F.collect_list(F.struct(learner, correct))).alias("_v"))
    pairs = one.select(F.explode("_v").alias("_a"), "_v").select("_a", F.explode(F.filter("_v", lambda x: x[learner] > F.col("_a")[learner])).alias("_b"))
    a, b = F.col("_a")[correct], F.col("_b")[correct]
    n = lambda x, y: F.sum(((a == x) & (b == y)).cast("double")) + 0.5
    t = pairs.groupBy(F.col("_a")[learner].alias("i"), F.col("_b")[learner].alias("j")).agg(n(1, 1).alias("n11"), n(0, 0).alias("n00"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), F.count(F.lit(1)).alias("n"))
    x, y = F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01")
    return t.agg(F.avg((x - y) / (x + y)).alias("q"), F.avg(F.col("n00") / F.col("n")).alias("double_fault"))


def kappa_diversity(votes: DataFrame, case: str, correct: str) -> DataFrame:
    """1 - Fleiss' kappa of correctness."""
    c = votes.groupBy(case).agg(F.sum(correct).cast("double").alias("r"), F.count(F.lit(1)).cast("double").alias("m"))
    r, m = F.col("r"), F.col("m")
    s = c.agg(F.avg((r * (r - 1) + (m - r) * (m - r - 1)) / (m * (m - 1))).alias("p"), (F.sum(r) / F.sum(m)).alias("q"))
    e = F.pow("q", 2) + F.pow(1 - F.col("q"), 2)
    return s.select((1 - ratio(F.col("p") - e, 1 - e)).alias("diversity"))


def lobag(votes: DataFrame, case: str, vote: str, label: str) -> DataFrame:
    """Bias plus unbiased minus biased variance of +-1 votes: mean of bias + var (1 - bias) - var bias."""
    c = votes.groupBy(case).agg(F.avg(vote).alias("m"), F.first(label).alias("y"))
    bias, var = (F.signum("m") != F.col("y")).cast("double"), 1 - F.pow("m", 2)
    return c.agg(F.avg(bias + var * (1 - bias) - var * bias).alias("lobag"))


def subspace_weights(models: DataFrame, keys: Sequence[str], worth: str, strategy: str, share: float = 0.9) -> DataFrame:
    """Which models stay: all, the winner, those within a share of the best, or those at or above a percentile; with a linear weight."""
    w = Window.partitionBy(*keys)
    best, low = F.max(worth).over(w), F.min(worth).over(w)
    cond = {"all": F.lit(True), "winner": F.row_number().over(w.orderBy(F.desc(worth), *[c for c in models.columns if c not in keys])) == 1, "range": F.col(worth) >= best * share, "percentile": F.percent_rank().over(w.orderBy(worth)) >= share}[strategy]
    return models.withColumn("_in", cond).withColumn("weight", F.coalesce(ratio(F.col(worth) - low, best - low), F.lit(1.0))).filter("_in").drop("_in")


def max_wins(scores: DataFrame, case: str, klass: str, score: str, how: str = "sum") -> DataFrame:
    """The class of the largest combined score of its dichotomisers; the smaller class of equals."""
    v = F.col(score)
    combined = {"sum": F.sum(v), "mean": F.avg(F.when(v != 0, v)), "median": F.median(F.when(v != 0, v)), "majority": F.sum((v > 0).cast("double"))}[how]
    return scores.groupBy(case, klass).agg(combined.alias("_s")).groupBy(case).agg(F.min_by(klass, F.struct(-F.col("_s"), klass)).alias(klass))


def ecoc(outputs: DataFrame, case: str, position: str, value: str, codes: DataFrame, klass: str, code: str, distance: str = "hamming") -> DataFrame:
    """Nearest code word; codes: klass, position, code (1, -1, 0), a few rows."""
    x, y = F.col(value), F.col(code)
    sign = F.signum(x)
    match, miss, zero = ((sign == y) & (y != 0)).cast("double"), ((sign != y) & (y != 0)).cast("double"), (y == 0).cast("double")
    d = {
        "hamming": F.sum(F.abs(sign - y)) / 2, "euclidean": F.sqrt(F.sum(F.pow(x - y, 2))), "attenuated": F.sqrt(F.sum(F.pow(x - y, 2) * y * y)),
        "linear": -F.sum(x * y), "laplacian": (F.sum(match) + F.sum(miss) - F.sum(zero) * 0 + 2) / (F.sum(match) + 1),
    }[distance]
    dist = outputs.join(F.broadcast(codes), position).groupBy(case, klass).agg(d.alias("_d"))
    return dist.groupBy(case).agg(F.min_by(klass, F.struct("_d", klass)).alias(klass), F.min("_d").alias("distance"))


def one_vs_one_codes(classes: Sequence) -> list[tuple]:
    """klass, position, code for all pairs."""
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    return [(c, k, 1 if c == a else -1 if c == b else 0) for k, (a, b) in enumerate(pairs) for c in classes]


def one_vs_all_codes(classes: Sequence) -> list[tuple]:
    return [(c, k, 1 if c == a else -1) for k, a in enumerate(classes) for c in classes]


def dag(classes: Sequence, pair: dict[tuple, Column]) -> Column:
    """Walks the graph of pairs: the loser of (first, last) goes, until one class is left. pair[(a, b)] > 0 speaks for a."""
    if len(classes) == 1:
        return F.lit(classes[0])
    a, b = classes[0], classes[-1]
    return F.when(pair[a, b] > 0, dag(classes[:-1], pair)).otherwise(dag(classes[1:], pair))


def late_fusion(parts: Sequence[DataFrame], case: str, score: str) -> DataFrame:
    out = parts[0].select(case, score)
    for p in parts[1:]:
        out = out.unionByName(p.select(case, score))
    return out.groupBy(case).agg(F.avg(score).alias(score))


def stack(preds: DataFrame, case: str, learner: str, pred: str, learners: Sequence) -> DataFrame:
    """First-level predictions as columns."""
    return preds.groupBy(case).pivot(learner, list(learners)).agg(F.first(pred))
