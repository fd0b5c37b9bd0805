"""What several partitions, learners or grid nodes agree on: feature consensus, multi-class bias and variance, bagging of holdouts, fusion, node choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.order import running
from .ensembles import late_fusion, max_wins
from .preprocess import with_parameters


def agreement(masks: DataFrame, feature: str, chosen: str, mode: str, at: float, tolerance: int = 0, least: int = 1) -> DataFrame:
    """feature, agreement (percent of partitions that chose it), keep. masks: a row for each partition and feature, chosen 0 or 1.

    threshold: the highest of at, at - 1, .. at - tolerance that at least `least` features reach (an error if none does); top: the
    first `at`; share: the first ceil(at percent); above: more than `at` percent. Equal agreements go by feature.
    """
    rate = masks.groupBy(feature).agg((100 * F.sum(F.col(chosen).cast("double")) / F.count(F.lit(1))).alias("agreement"))
    if mode == "above":
        return rate.withColumn("keep", F.col("agreement") > at)
    if mode == "threshold":
        steps = [at - i for i in range(tolerance + 1)]
        found = F.coalesce(*(F.when(F.sum((F.col("agreement") >= s).cast("long")) >= least, float(s)) for s in steps), F.raise_error(F.lit(f"fewer than {least} features within {at} - {tolerance} percent")).cast("double"))
        return with_parameters(rate, rate.agg(found.alias("_at"))).withColumn("keep", F.col("agreement") >= F.col("_at")).drop("_at")
    placed = running(rate, [], "agreement", {"_place": ("sum", F.lit(1))}, [feature], True, {"_n": F.lit(1)})
    most = F.lit(at) if mode == "top" else F.ceil(F.col("_n") * at / 100)
    return placed.withColumn("keep", F.col("_place") <= most).drop("_place", "_n")


def prune_masks(masks: DataFrame, agreed: DataFrame, feature: str, chosen: str) -> DataFrame:
    """Each partition's own mask without the features that were not kept."""
    return masks.join(agreed.select(feature, "keep"), feature, "left").withColumn(chosen, F.when(F.coalesce("keep", F.lit(False)), F.col(chosen)).otherwise(0)).drop("keep")


def lobag_multi(votes: DataFrame, case: str, klass: str, vote: str, label: str) -> DataFrame:
    """Error of the combined class, plus mean variance of the votes where it is right, minus that where it is wrong; either is 0 if there is no such case.

    votes: a row for each case, class and learner; a case's variance is the mean over classes of the learners' population variance.
    """
    won = max_wins(votes, case, klass, vote).withColumnRenamed(klass, "_won")
    spread = votes.groupBy(case, klass).agg(F.var_pop(vote).alias("_v"), F.first(label).alias("_y")).groupBy(case).agg(F.avg("_v").alias("_v"), F.first("_y").alias("_y"))
    wrong = F.col("_won") != F.col("_y")
    return spread.join(won, case).agg((F.avg(wrong.cast("double")) + F.coalesce(F.avg(F.when(~wrong, F.col("_v"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(wrong, F.col("_v"))), F.lit(0.0))).alias("lobag"))


def bag_holdouts(parts: Sequence[DataFrame], case: str, score: str) -> DataFrame:
    """case, n, score (median of all models' predictions), sd, positive (share above 0); missing predictions are skipped."""
    every = reduce(DataFrame.unionByName, [p.select(case, score) for p in parts])
    return every.groupBy(case).agg(F.count(score).alias("n"), F.median(score).alias(score), F.stddev_samp(score).alias("sd"), F.avg((F.col(score) > 0).cast("double")).alias("positive"))


def fuse(parts: dict[str, DataFrame], case: str, mode: int, prepare: Callable[[DataFrame], DataFrame], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """case, score of several sources. 1: joined, then prepared; 2: prepared one by one, then joined; 3: one prediction each, averaged; 0: one prediction each, with its source.

    Only cases that every source has are kept by 1 and 2.
    """
    join = lambda frames: reduce(lambda a, b: a.join(b, case), frames)
    if mode == 1:
        return predict(prepare(join(list(parts.values()))))
    if mode == 2:
        return predict(join([prepare(p) for p in parts.values()]))
    each = {n: predict(prepare(p)) for n, p in parts.items()}
    if mode == 3:
        return late_fusion(list(each.values()), case, "score")
    return reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(n)) for n, p in each.items()])


def choose_percentile(nodes: DataFrame, scores: DataFrame, klass: str, node: str, worth: str, case: str, score: str, label: str, percents: Sequence[float]) -> DataFrame:
    """klass, percent, nodes, accuracy: for each class the percentile of worth whose nodes together are most often right, the highest of equals.

    nodes: klass, node, worth (a small grid). scores: klass, node, case, score, label (1 or -1); a mean score of 0 speaks for 1.
    """
    cut = nodes.groupBy(klass).agg(*(F.percentile(worth, p / 100).alias(f"_p{i}") for i, p in enumerate(percents)))
    steps = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("percent"), F.col(f"_p{i}").alias("cut")) for i, p in enumerate(percents))))
    kept = nodes.join(cut, klass).withColumn("_s", steps).filter(F.col(worth) >= F.col("_s")["cut"]).select(klass, node, F.col("_s")["percent"].alias("percent"))
    right = (F.when(F.avg(score) >= 0, 1).otherwise(-1) == F.first(label)).cast("double").alias("_right")
    each = scores.join(kept, [klass, node]).groupBy(klass, "percent", case).agg(right, F.count(F.lit(1)).alias("_nodes"))
    rate = each.groupBy(klass, "percent").agg(F.avg("_right").alias("accuracy"), F.max("_nodes").alias("nodes"))
    best = F.row_number().over(Window.partitionBy(klass).orderBy(F.desc("accuracy"), F.desc("percent")))
    return rate.withColumn("_r", best).filter("_r = 1").select(klass, "percent", "nodes", "accuracy")


def work_blocks(cells: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """The cells of a search grid with the worker (from 1) of their contiguous block; the last blocks may be shorter or empty."""
    w = Window.orderBy(*order)
    size = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / workers)
    return cells.withColumn("worker", (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("int"))


def local_reference(source: DataFrame, target: DataFrame, tolerances: dict[str, float], column: str, how: str = "znorm", winsor: float = 10.0, most: int = 20_000) -> DataFrame:
    """The target's rows with `column` set against the source rows whose covariates all lie within tolerance, and their number n.

    znorm: (x - median) / sample SD, 0 where that is not defined, held to +-winsor. partcorr: the residual of the references' line on
    the first covariate; their mean's if it is constant. Without any reference: null. Source rows that agree are counted first, and the distinct covariates of the
    target, `most` at most, are the stated queries that travel to them.
    """
    cov = list(tolerances)
    goal = target.select(*cov).dropna().distinct()
    if goal.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} different target covariates")
    first, width = cov[0], tolerances[cov[0]]
    bucket = lambda c: F.floor(c / width) if width else c
    near = F.explode(F.array(*(bucket(F.col(first)) + i for i in (-1, 0, 1)))) if width else F.col(first)
    base = source.select(*(F.col(c).alias(f"_s_{c}") for c in cov), F.col(column).cast("double").alias("_y")).dropna()
    base = base.groupBy(*(f"_s_{c}" for c in cov), "_y").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket(F.col(f"_s_{first}")))
    met = base.join(F.broadcast(goal.withColumn("_b", near)), "_b").filter(reduce(lambda a, b: a & b, (F.abs(F.col(f"_s_{c}") - F.col(c)) <= t for c, t in tolerances.items())))
    origin = source.agg(F.avg(column).alias("_0"), F.avg(first).alias("_1")).first()
    y, x, n = F.col("_y") - F.lit(origin["_0"]), F.col(f"_s_{first}") - F.lit(origin["_1"]), F.col("_n")
    sums = met.groupBy(*cov).agg(F.percentile("_y", 0.5, n).alias("_mid"), F.sum(n).alias("n"), *(F.sum(n * e).alias(a) for a, e in {"_sy": y, "_syy": y * y, "_sx": x, "_sxx": x * x, "_sxy": x * y}.items()))
    out = target.join(sums, cov, "left")
    k = F.col("n")
    if how == "znorm":
        sd = F.sqrt(F.greatest(F.col("_syy") - F.col("_sy") * F.col("_sy") / k, F.lit(0.0)) / F.nullif(k - 1, F.lit(0)))
        z = F.coalesce(stats.ratio(F.col(column) - F.col("_mid"), sd), F.when(F.col(column).isNotNull() & k.isNotNull(), 0.0))
        value = F.when(z.isNotNull(), F.greatest(F.lit(-winsor), F.least(F.lit(winsor), z)))
    else:
        slope = F.coalesce(stats.ratio(k * F.col("_sxy") - F.col("_sx") * F.col("_sy"), k * F.col("_sxx") - F.col("_sx") * F.col("_sx")), F.lit(0.0))
        value = F.col(column) - F.lit(origin["_0"]) - F.col("_sy") / k - slope * (F.col(first) - F.lit(origin["_1"]) - F.col("_sx") / k)
    return out.withColumn(column, F.when(k.isNotNull(), value)).drop(*(c for c in sums.columns if c.startswith("_")))
