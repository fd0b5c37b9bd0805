"""Preprocessing steps: `fit` sees training rows only and returns one small parameter row (or one for each group); `apply` joins it.

Results of the standardiser are rounded at 9 digits. Spreads that vanish count as 1e-5.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import written
from . import exact_near
from .neighbours import numbered

TINY, DIGITS, MOST_MATCHED = 1e-5, 9, 10


def with_parameters(df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with their parameters: a single row, or one for each of a few groups; a larger table is left to the planner."""
    return df.join(params, list(keys), "left") if keys else df.join(F.broadcast(params), F.lit(True))


def scale(df: DataFrame, train: DataFrame, columns: Sequence[str], mode: int = 1) -> DataFrame:
    """1: to 0..1, 2: to -1..1, 3: by the largest absolute value; a constant gives 0. Values outside the training range go outside."""
    p = train.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))
    out = with_parameters(df, p)

    def one(c: str) -> Column:
        x, lo, hi = F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        if mode == 3:
            return F.coalesce(x / F.nullif(F.greatest(F.abs(lo), F.abs(hi)).cast("double"), F.lit(0.0)), F.when(x.isNotNull() & lo.isNotNull(), 0.0))
        unit = F.coalesce((x - lo) / F.nullif((hi - lo).cast("double"), F.lit(0.0)), F.when(x.isNotNull(), 0.0))
        return unit if mode == 1 else F.when(hi > lo, 2 * unit - 1).otherwise(unit)

    return out.withColumns({c: one(c) for c in columns}).drop(*p.columns)


def unscale(c: Column, lo: float, hi: float, mode: int = 1) -> Column:
    return (c if mode == 1 else c / 2 + 0.5) * (hi - lo) + lo


def standardise(df: DataFrame, train: DataFrame, column: str, by: str = "mean", winsor: float | None = None) -> DataFrame:
    """(x - centre) / spread: mean and sample SD, or median and interquartile range; `winsor` clips at that many and re-centres once."""
    if by == "mean":
        p = train.agg(F.avg(column).alias("_c"), F.stddev_samp(column).alias("_s"))
    else:
        q = stats.hazen(train, [], column, [0.25, 0.5, 0.75])
        at = lambda v: F.max(F.when(F.col("p") == v, F.col("q")))
        p = q.agg(at(0.5).alias("_c"), (at(0.75) - at(0.25)).alias("_s"))
    z = F.round((F.col(column) - F.col("_c")) / F.when(F.col("_s") > 2.3e-308, F.col("_s")).otherwise(TINY), DIGITS)
    out = with_parameters(df, p).withColumn(column, z)
    if winsor is not None:
        clip = lambda x: stats.held(x, -winsor, winsor)
        again = with_parameters(train, p).select(clip(z).alias("_z")).agg(F.avg("_z").alias("_m"))
        out = with_parameters(out.withColumn(column, clip(F.col(column))), again).withColumn(column, F.col(column) - F.col("_m")).drop("_m")
    return out.drop("_c", "_s")


def centre(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    return with_parameters(df, train.agg(F.avg(column).alias("_c"))).withColumn(column, F.col(column) - F.col("_c")).drop("_c")


def unit_norm(df: DataFrame, train: DataFrame, column: str, power: float = 1.0) -> DataFrame:
    """(x - mean) over the norm of what is left; 0 where the norm is."""
    mean = train.agg(F.avg(column).alias("_c"))
    size = with_parameters(train, mean).agg(F.first("_c").alias("_c"), F.pow(F.sum(F.pow(F.abs(F.col(column) - F.col("_c")), power)), 1 / power).alias("_s"))
    return with_parameters(df, size).withColumn(column, F.when(F.col("_s") == 0, 0.0).otherwise((F.col(column) - F.col("_c")) / F.col("_s"))).drop("_c", "_s")


def percent_of_group(df: DataFrame, train: DataFrame, column: str, group: str) -> DataFrame:
    p = train.groupBy(group).agg(F.avg(column).alias("_c"))
    return with_parameters(df, p, [group]).withColumn(column, 100 * F.col(column) / (F.col("_c") + 1) - 100).drop("_c")


def remove_mean_difference(df: DataFrame, train: DataFrame, column: str, group: str) -> DataFrame:
    """x - (group mean - overall mean); a group that training lacks uses its own mean."""
    known, own = train.groupBy(group).agg(F.avg(column).alias("_g")), df.groupBy(group).agg(F.avg(column).alias("_o"))
    out = with_parameters(with_parameters(with_parameters(df, known, [group]), own, [group]), train.agg(F.avg(column).alias("_a")))
    return out.withColumn(column, F.coalesce(F.col(column) - (F.coalesce("_g", "_o") - F.col("_a")), F.lit(0.0))).drop("_g", "_o", "_a")


def residualise(df: DataFrame, train: DataFrame, columns: Sequence[str], covariates: Sequence[str], revert: bool = False) -> DataFrame:
    """x - [1 G] beta with beta from the normal equations of the training rows, all columns in one aggregate."""
    g = ["_1", *covariates]
    x = train.dropna(subset=[*columns, *covariates]).withColumn("_1", F.lit(1.0))
    pairs = [(a, b) for a in g for b in [*g, *columns]]
    r = x.agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs))).first()
    m = np.array([r[f"s{k}"] or 0.0 for k in range(len(pairs))]).reshape(len(g), -1)
    beta = np.linalg.pinv(m[:, : len(g)]) @ m[:, len(g) :]
    fitted = lambda k: reduce(lambda a, b: a + b, [F.lit(float(beta[0, k]))] + [F.col(c) * float(beta[i + 1, k]) for i, c in enumerate(covariates)])
    return df.withColumns({c: F.col(c) + fitted(k) if revert else F.col(c) - fitted(k) for k, c in enumerate(columns)})


def impute_mean(df: DataFrame, train: DataFrame, columns: Sequence[str], median: bool = False) -> DataFrame:
    p = train.agg(*((F.median(c) if median else F.avg(c)).alias(f"_m_{c}") for c in columns))
    return with_parameters(df, p).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*p.columns)


def impute_case_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A case's missing values become the median of the others."""
    v = F.array_sort(F.array_compact(F.array(*(F.col(c).cast("double") for c in columns))))
    n = F.size(v)
    mid = F.when(n > 0, (F.element_at(v, F.greatest(F.ceil(n / 2), F.lit(1)).cast("int")) + F.element_at(v, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))) / 2)
    return df.withColumn("_med", mid).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_med")) for c in columns}).drop("_med")


def impute_knn(df: DataFrame, train: DataFrame, columns: Sequence[str], k: int = 5, metric: str = "euclidean") -> DataFrame:
    """Median over the k nearest complete training rows, by the columns a case has; distances equal at 12 digits go by the rows' values in column order.

    The different training rows (the first k of equal ones) go to the tasks in parts of a million; cases stay distributed.
    """
    cols = list(columns)
    pool = train.select(*(F.col(c).cast("double").alias(c) for c in cols)).dropna().groupBy(*cols).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("double").alias("_n"))
    shared = exact_near.parts_of(pool, [*cols, "_n"])

    def nearest(part, have, x):
        """Distances and rows of the k nearest of one part, equal ones in order of their values."""
        *values, n = part.value
        rows = np.column_stack(values)
        rows = np.repeat(rows, n.astype(int), axis=0)
        rows = rows[np.lexsort(rows.T[::-1])]
        if metric == "hamming" and have.sum() <= MOST_MATCHED:
            return exact_near.matched(rows, have, x, k)
        d, i = exact_near.Boxes(rows[:, have], k, metric, 12).near(x)
        return d, np.where((i >= 0)[..., None], rows[np.maximum(i, 0)] if len(rows) else 0.0, np.nan)

    def each(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        x = pdf[cols].to_numpy(float)
        gaps = np.isnan(x)
        for pattern in np.unique(gaps[gaps.any(1)], axis=0):
            have = ~pattern
            which = np.flatnonzero((gaps == pattern).all(1))
            if not have.any():
                continue
            q, back = np.unique(x[which][:, have], axis=0, return_inverse=True)
            best = np.full((len(q), k), np.inf), np.full((len(q), k, len(cols)), np.nan)
            for part in shared:
                d, r = nearest(part, have, q)
                dd, rr = np.concatenate([best[0], d], 1), np.concatenate([best[1], r], 1)
                at = np.lexsort((*(rr[..., j] for j in reversed(range(len(cols)))), dd), axis=1)[:, :k]
                best = np.take_along_axis(dd, at, 1), np.take_along_axis(rr, at[..., None], 1)
            if len(q) and not np.isinf(best[0][:, 0]).all():
                x[np.ix_(which, pattern)] = np.nanmedian(best[1][:, :, pattern], axis=1)[back.ravel()]
        yield pdf.assign(**{c: x[:, j] for j, c in enumerate(cols)})

    out = df.withColumns({c: F.col(c).cast("double") for c in cols})
    slices = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.repartition(slices).mapInPandas(each, out.schema)


def impute_downshift(df: DataFrame, train: DataFrame, column: str, row_id: str, seed: int = 42) -> DataFrame:
    """Missing because small: a normal draw 1.8 SD below the mean, 0.3 SD wide, hashed from the row's id."""
    p = train.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), row_id), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(6.283185307179586 * u(1))
    return with_parameters(df, p).withColumn(column, F.coalesce(F.col(column), F.col("_m") - 1.8 * F.col("_s") + 0.3 * F.col("_s") * z)).drop("_m", "_s")


def discretise(df: DataFrame, train: DataFrame, column: str, top: float = 5.0, step: float = 0.5) -> DataFrame:
    """The next of 0, step, 2 step, ... past |z|, with the sign of z, held at top."""
    z = (F.col(column) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(TINY)
    level = stats.held(F.ceil(F.round(F.abs(z) / step, 9)) * step, high=top)
    return with_parameters(df, train.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))).withColumn(column, F.signum(z) * level).drop("_m", "_s")


def binned(c: Column, borders: Sequence[float]) -> Column:
    """The number of borders at or below a value."""
    return sum((c >= b).cast("int") for b in borders)


def keep_informative(df: DataFrame, columns: Sequence[str], threshold: float = 100.0) -> list[str]:
    """Columns that vary, have no missing value, and no value that makes up `threshold` percent."""
    flags = df.agg(*(F.struct(F.var_samp(c).alias("v"), F.count(c).alias("n"), F.count(F.lit(1)).alias("t")).alias(c) for c in columns)).first()
    able = [c for c in columns if flags[c]["n"] == flags[c]["t"] and (flags[c]["v"] or 0) > 0]
    if threshold >= 100 or not able:
        return able
    long = df.select(*(F.col(c).cast("double").alias(c) for c in able)).unpivot([], able, "feature", "value").groupBy("feature", "value").count()
    top = {r["feature"]: r["p"] for r in long.groupBy("feature").agg((100 * F.max("count") / F.sum("count")).alias("p")).collect()}
    return [c for c in able if top[c] < threshold]


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, lam) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float, offset: float | Column = 0.0) -> Column:
    v = x + offset
    return F.ln(v) if lam == 0 else (F.pow(v, lam) - 1) / lam


def yeo_johnson_lambda(train: DataFrame, column: str, lambdas: Sequence[float] = tuple(k / 10 for k in range(-20, 41))) -> float:
    """The grid value of the largest likelihood, all in one aggregate."""
    x = F.col(column).cast("double")
    r = train.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), F.count(x).alias("n"), *(F.var_pop(yeo_johnson(x, lam)).alias(f"v{k}") for k, lam in enumerate(lambdas))).first()
    like = [-r["n"] / 2 * np.log(max(r[f"v{k}"] or 0, 1e-300)) + (lam - 1) * (r["s"] or 0) for k, lam in enumerate(lambdas)]
    return float(lambdas[int(np.argmax(like))])


def disparate_impact(df: DataFrame, train: DataFrame, column: str, group: str, lam: float = 1.0, parts: int = 20) -> DataFrame:
    """Moves each value towards the median over groups of the value at its group's quantile."""
    probs = [(k + 0.5) / parts for k in range(parts)]
    q = stats.hazen(train, [group], column, probs)
    target = q.groupBy("p").agg(F.median("q").alias("t"))
    table = q.join(target, "p").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("q", "t"))).alias("_m"))
    x = F.col(column)
    below, above = F.filter("_m", lambda e: e["q"] <= x), F.filter("_m", lambda e: e["q"] > x)
    a, b = F.element_at(below, -1), F.element_at(above, 1)
    mid = a["t"] + (b["t"] - a["t"]) * (x - a["q"]) / (b["q"] - a["q"])
    new = F.when(F.size(below) == 0, F.element_at(F.col("_m"), 1)["t"]).when(F.size(above) == 0, F.element_at(F.col("_m"), -1)["t"]).otherwise(mid)
    return with_parameters(df, table, [group]).withColumn(column, (1 - lam) * x + lam * new).drop("_m")


def combat(df: DataFrame, train: DataFrame, columns: Sequence[str], batch: str, rounds: int = 100) -> DataFrame:
    """Empirical-Bayes harmonisation of batch means and variances.

    One aggregate gives count, mean and sum of squares for each batch and column; the priors and posteriors are
    solved on that small table, and applied as constants by batch.
    """
    r = train.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)), *(F.var_pop(c).alias(f"v{k}") for k, c in enumerate(columns))).orderBy(batch).collect()
    n = np.array([x["n"] for x in r], float)
    m, v = (np.array([[x[f"{a}{k}"] for k in range(len(columns))] for x in r], float) for a in "mv")
    grand = (n[:, None] / n.sum() * m).sum(0)
    pooled = np.maximum((n[:, None] * v).sum(0) / n.sum(), 1e-12)
    gamma, delta = (m - grand) / np.sqrt(pooled), v / pooled * (n / np.maximum(n - 1, 1))[:, None]
    out = []
    for b in range(len(r)):
        g0, t2 = gamma[b].mean(), gamma[b].var(ddof=1) if len(columns) > 1 else 1.0
        dm, dv = delta[b].mean(), max(delta[b].var(ddof=1) if len(columns) > 1 else 1.0, 1e-12)
        a, s = (2 * dv + dm**2) / dv, (dm * dv + dm**3) / dv
        g, d = gamma[b].copy(), delta[b].copy()
        for _ in range(rounds):
            g_new = (t2 * n[b] * gamma[b] + d * g0) / (t2 * n[b] + d)
            ss = n[b] * (v[b] / pooled + (gamma[b] - g_new) ** 2)
            d_new = (0.5 * ss + s) / (n[b] / 2 + a - 1)
            done = max(np.abs(g_new - g).max(), np.abs(d_new - d).max()) < 1e-6
            g, d = g_new, d_new
            if done:
                break
        out.append((r[b][batch], [float(x) for x in g], [float(x) for x in np.sqrt(d)]))
    p = df.sparkSession.createDataFrame(out, f"{batch} {train.schema[batch].dataType.simpleString()}, _g array<double>, _d array<double>")
    joined = with_parameters(df, F.broadcast(p), [batch])
    new = {c: (F.col(c) - float(grand[k]) - F.col("_g")[k] * float(np.sqrt(pooled[k]))) / F.col("_d")[k] + float(grand[k]) for k, c in enumerate(columns)}
    return joined.withColumns(new).drop("_g", "_d")


def oversample(df: DataFrame, columns: Sequence[str], label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """ADASYN: as many new minority rows as the largest class is ahead, between neighbours, more where other classes are near.

    Classes are counted over all complete rows. Minority rows stay distributed and meet all rows in blocks; where no other class is near
    any of them, all get the same number. A single minority row is copied.
    """
    rows = numbered(df.select(label, *columns)).withColumn("_v", F.array(*(F.col(c).cast("double") for c in columns)))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    few = min(counts, key=lambda c: (counts[c], c), default=None)
    kind = df.schema[label].dataType.simpleString()
    want = max(counts.values(), default=0) - counts.get(few, 0)
    if not want:
        return df.sparkSession.createDataFrame([], f"{label} {kind}, " + ", ".join(f"{c} double" for c in columns))
    mine = rows.filter(F.col(label) == F.lit(few))
    near = exact_near.search_many(rows, mine, "_id", "_v", k).join(rows.select(F.col("_id").alias("b"), label), "b")
    weight = written(mine.select("_id").join(near.groupBy(F.col("q").alias("_id")).agg(F.sum((F.col(label) != F.lit(few)).cast("long")).alias("_w")), "_id", "left").withColumn("_w", F.coalesce("_w", F.lit(0))), "weights")
    if not weight.agg(F.sum("_w")).first()[0]:
        weight = weight.withColumn("_w", F.lit(1).cast("long"))
    # running totals: of blocks of ids on the driver, within a block by a window
    weight, before, total = weight.withColumn("_block", F.floor(F.col("_id") / 65536)), [], 0
    for b, w in sorted(tuple(r) for r in weight.groupBy("_block").agg(F.sum("_w")).collect()):
        before.append((b, total))
        total += w
    weight = weight.join(F.broadcast(df.sparkSession.createDataFrame(before, "_block long, _before long")), "_block")
    weight = weight.withColumn("_to", F.col("_before") + F.sum("_w").over(Window.partitionBy("_block").orderBy("_id")))
    upto = lambda c: F.floor((2 * c.cast("decimal(20,0)") * want + total) / (2 * total)).cast("long")
    placed = weight.withColumn("_n", upto(F.col("_to")) - upto(F.col("_to") - F.col("_w"))).filter("_n > 0").select("_id", "_n")
    own = exact_near.search_many(mine, mine, "_id", "_v", k).join(mine.select(F.col("_id").alias("b"), F.col("_v").alias("_o")), "b").groupBy(F.col("q").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("d", "b", "_o"))).alias("_near"))
    each = placed.join(mine.select("_id", "_v"), "_id").join(own, "_id", "left").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), "_id", "_c"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    other = F.coalesce(F.get(F.col("_near"), F.floor(u(0) * F.size("_near")).cast("int"))["_o"], F.col("_v"))
    made = each.withColumn("_o", other).withColumn("_u", u(1))
    return made.select(F.lit(few).cast(kind).alias(label), *((F.col("_v")[j] + F.col("_u") * (F.col("_o")[j] - F.col("_v")[j])).alias(c) for j, c in enumerate(columns)))


def sparsify(edges: DataFrame, case: str, weight: str, share: float) -> DataFrame:
    """The strongest share of each case's edges."""
    w = Window.partitionBy(case).orderBy(F.abs(weight).desc())
    return edges.withColumn("_p", F.percent_rank().over(w)).filter(F.col("_p") < share).drop("_p")


def graph_metrics(edges: DataFrame, a: str = "a", b: str = "b", w: str = "w") -> DataFrame:
    """node, degree, strength, triangles, clustering of an undirected graph of distinct edges a < b."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(w).alias("w")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"), F.col(w).alias("w")))
    deg = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    # each wedge starts at its end of smaller degree, so a hub does not pair all its neighbours
    d = both.join(deg.select("u", F.col("degree").alias("du")), "u").join(deg.select(F.col("u").alias("v"), F.col("degree").alias("dv")), "v")
    up = d.filter((F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))).select("u", "v")
    wedge = up.join(up.select("u", F.col("v").alias("x")), "u").filter("v < x")
    tri = wedge.join(edges.select(F.col(a).alias("v"), F.col(b).alias("x")), ["v", "x"])
    per = tri.select(F.explode(F.array("u", "v", "x")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(per, "u", "left").select(F.col("u").alias("node"), "degree", "strength", t.alias("triangles"), F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))
