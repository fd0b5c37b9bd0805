"""Small operators in closed form: selection, picks, robust scales, filters, component bookkeeping, out-of-fold lines, exports."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.order import running
from .preprocess import with_parameters

#: Most distinct values that the pairwise scales take; beyond it, round the column first.
MOST_VALUES = 5000


def pick_variates(df: DataFrame, variates: dict[str, Sequence[str]], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The keys and the columns of the named variates."""
    return df.select(*keys, *(c for n in names for c in variates[n]))


def commit_selection(df: DataFrame, cases: Column, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Cases by a condition (null: left out), features by name; the keys stay."""
    return df.filter(cases).select(*keys, *features)


def swap_roles(discovery: DataFrame, holdout: DataFrame) -> DataFrame:
    """Both containers with their roles exchanged."""
    return holdout.withColumn("role", F.lit("discovery")).unionByName(discovery.withColumn("role", F.lit("holdout")))


def combination_at(m: Column, n: int, k: int) -> Column:
    """The m-th (from 1) k-subset of 1..n in lexicographic order, as an array; null beyond the last."""
    table = F.array(*(F.array(*(F.lit(comb(n - c, k - i) if i <= k else 0) for i in range(1, k + 2))) for c in range(1, n + 1)))
    start = F.struct(m.cast("long").alias("m"), F.array().cast("array<int>").alias("got"))

    def step(acc, c):
        i = F.size(acc["got"]) + 1
        above = F.element_at(F.element_at(table, c), F.least(i, F.lit(k + 1)))
        take = (i <= k) & (acc["m"] <= above)
        return F.struct(F.when((i > k) | take, acc["m"]).otherwise(acc["m"] - above).alias("m"), F.when(take, F.concat(acc["got"], F.array(c))).otherwise(acc["got"]).alias("got"))

    found = F.aggregate(F.array(*(F.lit(c) for c in range(1, n + 1))), start, step)["got"]
    return F.when(m.between(1, comb(n, k)), found)


def random_subsets(spark, n: int, k: int, many: int, seed: int = 0) -> DataFrame:
    """subset, feature: up to `many` different k-subsets of 1..n, drawn by rank so that none repeats."""
    total = comb(n, k)
    r = np.random.default_rng(seed)
    ranks = np.arange(total) if many >= total else np.unique(r.integers(0, total, 4 * many))
    ranks = ranks if many >= total else r.permutation(ranks)[:many]
    rows = spark.createDataFrame([(i, int(x) + 1) for i, x in enumerate(ranks)], "subset int, m long")
    return rows.select("subset", F.explode(combination_at(F.col("m"), n, k)).alias("feature"))


def weighted_pick(df: DataFrame, draws: DataFrame, item: str, weight: str, u: str) -> DataFrame:
    """For each draw the first item whose cumulative share exceeds u (0 <= u < 1). The items are few and travel with the draws."""
    one = df.agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), F.col(weight).cast("double").alias("w")))).alias("_items"), F.sum(F.col(weight).cast("double")).alias("_all"))
    cum = F.aggregate("_items", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(df.schema[item].dataType).alias("pick")), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.coalesce(a["pick"], F.when(a["s"] + x["w"] > F.col(u) * F.col("_all"), x["i"])).alias("pick")))
    return with_parameters(draws, one).withColumn(item, cum["pick"]).drop("_items", "_all")


def rank_uniform(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Ordinal ranks as 0..1, evenly spaced; missing values are left out."""
    x = running(df.filter(F.col(value).isNotNull()), [], value, {"_place": ("sum", F.lit(1))}, [tie], totals={"_n": F.lit(1)})
    return x.withColumn(out, F.when(F.col("_n") > 1, (F.col("_place") - 1) / (F.col("_n") - 1)).otherwise(1.0)).drop("_place", "_n")


def toeplitz(df: DataFrame, position: str, first_column: str, first_row: str) -> DataFrame:
    """i, j, value of the matrix whose first column and row a table gives by position (from 1)."""
    one = df.agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(first_column).cast("double").alias("c"), F.col(first_row).cast("double").alias("r")))).alias("_v"))
    places = lambda: F.explode(F.sequence(F.lit(1), F.size("_v")))
    return one.withColumn("i", places()).withColumn("j", places()).select("i", "j", F.when(F.col("i") >= F.col("j"), F.element_at("_v", F.col("i") - F.col("j") + 1)["c"]).otherwise(F.element_at("_v", F.greatest(F.col("j") - F.col("i") + 1, F.lit(1)))["r"]).alias("value"))


def nearest_spd(a: np.ndarray) -> np.ndarray:
    """The nearest symmetric positive definite matrix: the polar mean, its spectrum lifted until a Cholesky factor exists."""
    b = (a + a.T) / 2
    value, vector = np.linalg.eigh(b)
    out = (b + (vector * np.abs(value)) @ vector.T) / 2
    out = (out + out.T) / 2
    lift = np.spacing(np.linalg.norm(a)) or np.finfo(float).tiny
    while True:
        try:
            np.linalg.cholesky(out)
            return out
        except np.linalg.LinAlgError:
            out = out + np.eye(len(a)) * (max(0.0, -np.linalg.eigvalsh(out).min()) + lift)
            lift *= 2


def _counted(train: DataFrame, column: str) -> DataFrame:
    """One row: sorted (value, count) of a column, and their number of rows."""
    one = train.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return one.agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("_vc"), F.sum("c").alias("_n"), F.count(F.lit(1)).alias("_kinds")).select(F.when(F.col("_kinds") > MOST_VALUES, F.raise_error(F.lit(f"more than {MOST_VALUES} distinct values"))).otherwise(F.col("_vc")).alias("_vc"), "_n")


def _weighted_kth(pairs: Column, k: Column) -> Column:
    """The k-th (from 1) of sorted (v, c) counted c times."""
    return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("double").alias("x")), lambda a, p: F.struct((a["s"] + p["c"]).alias("s"), F.coalesce(a["x"], F.when(a["s"] + p["c"] >= k, p["v"])).alias("x")))["x"]


def pairwise_scale(train: DataFrame, column: str, how: str) -> DataFrame:
    """One row, scale: Qn (2.2219 times the C(n/2+1, 2)-th distance of pairs) or Sn (1.1926 times the low median of high medians of distances).

    Both work on distinct values with their counts, MOST_VALUES at most.
    """
    one = _counted(train, column)
    each = one.select("_n", "_vc", F.explode("_vc").alias("_x"))
    distances = F.sort_array(F.transform("_vc", lambda p: F.struct(F.abs(p["v"] - F.col("_x.v")).alias("v"), p["c"].alias("c"))))
    if how == "sn":
        high = each.select("_n", F.col("_x.c").alias("c"), _weighted_kth(distances, F.floor(F.col("_n") / 2) + 1).alias("v"))
        out = high.groupBy("v").agg(F.sum("c").alias("c"), F.max("_n").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("_d"), F.max("_n").alias("_n"))
        return out.select((1.1926 * _weighted_kth(F.col("_d"), F.floor((F.col("_n") + 1) / 2))).alias("scale"))
    pair = each.select("_n", "_x", F.explode("_vc").alias("_y")).filter("_y.v >= _x.v")
    times = F.when(F.col("_y.v") == F.col("_x.v"), F.col("_x.c") * (F.col("_x.c") - 1) / 2).otherwise(F.col("_x.c") * F.col("_y.c")).cast("long")
    h = F.floor(F.col("_n") / 2) + 1
    counts = pair.groupBy((F.col("_y.v") - F.col("_x.v")).alias("v")).agg(F.sum(times).alias("c"), F.max("_n").alias("_n"))
    placed = running(counts.filter("c > 0"), [], "v", {"_upto": ("sum", F.col("c"))})
    return placed.filter(F.col("_upto") >= (h * (h - 1) / 2)).agg((2.2219 * F.min("v")).alias("scale"))


def scale_by(df: DataFrame, train: DataFrame, column: str, how: str) -> DataFrame:
    """x over the training rows' Qn or Sn; null where that is 0."""
    return with_parameters(df, pairwise_scale(train, column, how)).withColumn(column, F.col(column) / F.nullif(F.col("scale"), F.lit(0.0))).drop("scale")


def spatial_median(df: DataFrame, columns: Sequence[str], steps: int = 60, close: float = 1e-9) -> list[float]:
    """L1-median of complete rows by Weiszfeld steps, one pass over the rows each: rows weigh by the inverse of their distance."""
    df = df.dropna(subset=list(columns))
    at = list(df.agg(*(F.avg(c) for c in columns)).first())
    for _ in range(steps):
        far = F.sqrt(sum(F.pow(F.col(c) - float(x), 2) for c, x in zip(columns, at, strict=True)))
        w = 1 / F.greatest(far, F.lit(1e-12))
        new = list(df.agg(*(F.sum(w * F.col(c)) / F.sum(w) for c in columns)).first())
        moved = sum((a - b) ** 2 for a, b in zip(at, new, strict=True)) ** 0.5
        at = new
        if moved <= close * (1 + sum(a * a for a in at) ** 0.5):
            break
    return at


def step_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """keys, q: array of the least values whose cumulative share reaches each probability."""
    v = stats.value_counts(df, keys, value)
    return v.groupBy(*keys).agg(F.array(*(F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * p), F.col(value))) for p in probs)).alias("q"))


def robust_fscore(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, score: squared distances of class medians from the median of all, over the squared IQRs of the classes."""
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))))
    whole = step_quantiles(long, ["feature"], "x", [0.5]).select("feature", F.col("q")[0].alias("m"))
    each = step_quantiles(long, ["feature", "label"], "x", [0.25, 0.5, 0.75]).join(whole, "feature")
    return each.groupBy("feature").agg(stats.ratio(F.sum(F.pow(F.col("q")[1] - F.col("m"), 2)), F.sum(F.pow(F.col("q")[2] - F.col("q")[0], 2))).alias("score"))


def entropy_filter(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, entropy in bits of its values."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("x")) for f in features)))).filter("x is not null")
    n = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("feature").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def information_filter(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, information in bits that its values share with the label; rows without either are left out."""
    long = df.select(F.col(label).cast("string").alias("y"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("x")) for f in features)))).filter("x is not null and y is not null")
    cells = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    both = cells.withColumns({"nx": F.sum("n").over(Window.partitionBy("feature", "x")), "ny": F.sum("n").over(Window.partitionBy("feature", "y")), "all": F.sum("n").over(Window.partitionBy("feature"))})
    return both.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("information"))


def correct_tails(df: DataFrame, train: DataFrame, truth: str, pred: str, out: str) -> DataFrame:
    """Prediction plus the error that a line in the prediction expects, fitted on training rows."""
    e = F.col(truth) - F.col(pred)
    p = train.agg(F.regr_slope(e, F.col(pred)).alias("_s"), F.regr_intercept(e, F.col(pred)).alias("_i"))
    return with_parameters(df, p).withColumn(out, F.col(pred) + F.col("_s") * F.col(pred) + F.col("_i")).drop("_s", "_i")


def keep_components(df: DataFrame, component: str, variance: str, share: float) -> DataFrame:
    """The leading components whose variances together first reach a share of all; adds explained, cumulative."""
    x = running(df.withColumn("_down", -F.col(variance)), [], "_down", {"_upto": ("sum", F.col(variance))}, [component], totals={"_all": F.col(variance)})
    x = x.withColumns({"explained": F.col(variance) / F.col("_all"), "cumulative": F.col("_upto") / F.col("_all")})
    return x.filter(F.col("cumulative") - F.col("explained") < share).drop("_down", "_upto", "_all")


def sort_components(df: DataFrame, components: Sequence[str], references: Sequence[str]) -> DataFrame:
    """component, reference, similarity, sign: each component with the reference it correlates with most (absolutely), largest first."""
    pairs = [F.struct(F.lit(c).alias("component"), F.lit(r).alias("reference"), F.corr(c, r).alias("r")) for c in components for r in references]
    long = df.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))
    best = long.groupBy("component").agg(F.max_by(F.struct("reference", "r"), F.struct(F.abs("r"), F.col("reference"))).alias("b"))
    return best.select("component", F.col("b.reference").alias("reference"), F.abs("b.r").alias("similarity"), F.signum("b.r").cast("int").alias("sign"))


def contributions(df: DataFrame, scores: Sequence[str], alpha: Sequence[float], bias: float) -> DataFrame:
    """decision = sum of alpha times score + bias; contribution of each component, and its absolute share."""
    part = [float(a) * F.col(s) for a, s in zip(alpha, scores, strict=True)]
    total = F.nullif(sum((F.abs(x) for x in part), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"decision": sum(part, F.lit(float(bias)))} | {f"part_{s}": x for s, x in zip(scores, part, strict=True)} | {f"share_{s}": F.abs(x) / total for s, x in zip(scores, part, strict=True)})


def permutation_index(df: DataFrame, row_id: str, strata: Sequence[str], perm: int, seed: int = 0) -> DataFrame:
    """row_id and the row that stands in for it: a permutation inside strata, by the md5 of (seed, perm, id)."""
    a = df.select(row_id, *strata).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(row_id)))
    b = df.select(F.col(row_id).alias("stand_in"), *strata).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(perm)), F.col("stand_in").cast("string"))), "stand_in")))
    return a.join(b, [*strata, "_n"]).select(row_id, *strata, "stand_in")


def class_folds(df: DataFrame, row_id: str, label: str, pairs: Sequence[tuple], k: int) -> DataFrame:
    """Rows of each dichotomiser (a pair of labels) with its side (1, -1) and inner fold, even inside labels."""
    f = F.row_number().over(Window.partitionBy(label).orderBy(row_id)) - 1
    long = df.withColumn("fold", f % k).select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("dichotomiser"), F.when(F.col(label) == a, 1).when(F.col(label) == b, -1).alias("side")) for i, (a, b) in enumerate(pairs)))))
    return long.filter("side is not null")


def parameter_text(flags: dict[str, str]) -> Column:
    """One learner's parameters as text: {flag: column}, null ones left out."""
    return F.concat_ws(" ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{flag} "), F.col(c).cast("string"))) for flag, c in flags.items()))


def out_of_fold_line(df: DataFrame, fold: str, x: str, y: str, out: str) -> DataFrame:
    """Adds for each row the line fitted to all other folds: from sums by fold, taken from the sums of all."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = {"n": F.count(F.lit(1)), "x": F.sum(F.col(x)), "y": F.sum(F.col(y)), "xx": F.sum(F.col(x) * F.col(x)), "xy": F.sum(F.col(x) * F.col(y))}
    own = ok.groupBy(fold).agg(*(c.cast("double").alias(f"_{n}") for n, c in sums.items()))
    rest = {n: F.sum(f"_{n}").over(Window.partitionBy()) - F.col(f"_{n}") for n in sums}  # a row for each fold
    left = own.select(fold, *(c.alias(f"_r{n}") for n, c in rest.items()))
    slope = (F.col("_rxy") - F.col("_rx") * F.col("_ry") / F.col("_rn")) / F.nullif(F.col("_rxx") - F.col("_rx") * F.col("_rx") / F.col("_rn"), F.lit(0.0))
    line = left.select(fold, slope.alias("_slope"), ((F.col("_ry") - slope * F.col("_rx")) / F.col("_rn")).alias("_at"))
    return df.join(line, fold, "left").withColumn(out, F.col("_at") + F.col("_slope") * F.col(x)).drop("_slope", "_at")


def permutation_importance(df: DataFrame, row_id: str, model: Column, features: Sequence[str], truth: str, perm: int = 0) -> DataFrame:
    """feature, importance: rise of the mean squared error of a prediction when the feature's values are permuted (permutation_index)."""
    out = df.agg(F.avg(F.pow(F.col(truth) - model, 2)).alias("_base"))
    moved = permutation_index(df, row_id, [], perm)
    for f in features:
        other = df.select(F.col(row_id).alias("stand_in"), F.col(f).alias("_other"))
        worse = df.join(moved, row_id).join(other, "stand_in").withColumn(f, F.col("_other")).agg(F.avg(F.pow(F.col(truth) - model, 2)).alias(f))
        out = out.join(F.broadcast(worse), F.lit(True))
    return out.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f) - F.col("_base")).alias("importance")) for f in features))))


def hierarchical_pairs(order: Sequence, scores: dict[tuple, Column]) -> Column:
    """Class that wins a chain of pairs: the first two meet, the winner meets the next. scores: {(a, b): positive where a wins}."""
    won = F.lit(order[0])
    for k in range(1, len(order)):
        new = won
        for a in order[:k]:
            new = F.when((won == F.lit(a)) & (scores[a, order[k]] < 0), F.lit(order[k])).otherwise(new)
        won = new
    return won


def weight_features(df: DataFrame, features: Sequence[str], weights: dict[str, float], hard: float | None = None) -> DataFrame:
    """soft: columns times their weights, scaled to a largest of 1. hard: only columns of at least that share of the largest weight, as they are."""
    top = max(abs(w) for w in weights.values())
    if hard is None:
        return df.withColumns({f: F.col(f) * (abs(weights[f]) / top) for f in features})
    return df.drop(*(f for f in features if abs(weights[f]) < hard * top))


def prediction_table(df: DataFrame, case: str, score: str, label: str) -> DataFrame:
    """For each case: number, mean and SD of its scores over models, a 95 % interval, the share of models on its label's side, and the label."""
    g = df.groupBy(case, label).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.avg((F.signum(score) == F.signum(F.col(label))).cast("double")).alias("right"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return g.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def relevance_table(df: DataFrame, feature: str, weight: str, chosen: str) -> DataFrame:
    """For each feature: how often models chose it, its mean weight and standard error there, and the share of positive ones."""
    w = F.when(F.col(chosen), F.col(weight))
    return df.groupBy(feature).agg(F.avg(F.col(chosen).cast("double")).alias("probability"), F.avg(w).alias("mean"), (F.stddev_samp(w) / F.sqrt(F.count(w))).alias("error"), F.avg((w > 0).cast("double")).alias("positive"))


def consistency_significance(df: DataFrame, feature: str, value: str) -> DataFrame:
    """feature, z: a consistency over the SD of all of them."""
    return with_parameters(df, df.agg(F.stddev_samp(value).alias("_s"))).select(feature, (F.col(value) / F.nullif(F.col("_s"), F.lit(0.0))).alias("z"))


def redundancy_penalty(df: DataFrame, similarity: str, low: float, high: float, weight: float, out: str) -> DataFrame:
    """A penalty that rises from 0 at similarity `low` to `weight` at `high`, linearly."""
    return df.withColumn(out, weight * stats.held((F.col(similarity) - low) / (high - low), 0.0, 1.0))
