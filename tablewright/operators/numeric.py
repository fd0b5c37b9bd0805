"""Numeric operators on moments, grids and small matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import running
from ..functions import stats

#: Rows that are paired with as many queries at a time, and rows of a task.
GOWER_BLOCK, GOWER_TASK = 256, 4096


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> list[dict]:
    """Rows of keys, n, mean (vector), cov (sample) from one aggregate; complete cases."""
    x = df.dropna(subset=list(columns)).select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns)] + [F.covar_samp(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    out = []
    for r in (x.groupBy(*keys).agg(*aggs) if keys else x.agg(*aggs)).collect():
        cov = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
        out.append({**{k: r[k] for k in keys}, "n": r["n"], "mean": np.array([r[f"m_{c}"] for c in columns]), "cov": cov})
    return out


def _coded(batch: pa.RecordBatch, numbers: int, sets: Sequence[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Numbers with NaN where missing, places of kinds in their sets with -1 where missing and -2 where a set lacks them."""
    kinds = []
    for col, known in zip(batch.columns[1 + numbers:], sets, strict=True):
        at = pc.fill_null(pc.index_in(col, value_set=known), -2).to_numpy(zero_copy_only=False)
        kinds.append(np.where(col.is_null().to_numpy(zero_copy_only=False), -1, at))
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:1 + numbers]], kinds


def _blocks(keys: pa.Array, numbers: list[np.ndarray], kinds: list[np.ndarray]):
    """Of each GOWER_BLOCK rows in turn: the keys, the values of the different rows, and which of them each row has. Equal rows stand together."""
    for lo in range(0, len(keys), GOWER_BLOCK):
        here = [x[lo:lo + GOWER_BLOCK] for x in (*numbers, *kinds)]
        new = np.zeros(len(keys[lo:lo + GOWER_BLOCK]), bool)
        new[0] = True
        for x in here:
            new[1:] |= (x[1:] != x[:-1]) & ((x[1:] == x[1:]) | (x[:-1] == x[:-1]))
        yield keys[lo:lo + GOWER_BLOCK], [x[new] for x in here], np.cumsum(new) - 1


def _gower(a: list[np.ndarray], b: list[np.ndarray], spans: Sequence[float]) -> np.ndarray:
    """The similarities of all rows of a with all of b, rounded as DuckDB does; NaN where they have no part in common."""
    total, n = np.zeros((2, len(a[0]), len(b[0])))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if k < len(spans):
            part = np.abs(x[:, None] - y) / spans[k]
            there = part == part
            total += there
            total -= np.where(there, part, 0)
        else:
            there = (x[:, None] != -1) & (y != -1)
            total += (x[:, None] == y) & there
        n += there
    with np.errstate(invalid="ignore"):
        return np.floor(total / n * 1e9 + 0.5) / 1e9


def gower(df: DataFrame, key: str, numbers: Sequence[str], kinds: Sequence[str], queries: DataFrame | None = None) -> DataFrame:
    """Mean similarity of each pair of a small case set, or of each query with all other rows: 1 - |difference| / range over all rows, or equality; missing parts are skipped.

    The pairs are by far the most of it, so their order is made for the files they may go to: a block of queries against a block of rows, each sorted
    by values. A query's key stands in one run, the rows' keys recur, and so do the similarities of equal rows, which are reckoned once a block.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    kind = lambda c: F.col(c) + F.lit(0).cast(dict(df.dtypes)[c]) if dict(df.dtypes)[c] in ("float", "double") else F.col(c)  # noqa: E731  # no -0.0
    values = [f"_v{k}" for k in range(len(numbers) + len(kinds))]
    plain = lambda d: d.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(v.alias(name) for v, name in zip([*map(number, numbers), *map(kind, kinds)], values, strict=True)))
    rows, *spans = df.agg(F.count(F.lit(1)), *(F.max(number(c)) - F.min(number(c)) for c in numbers)).first()
    spans = [float(x) if x else np.nan for x in spans]
    spark = df.sparkSession
    asked = spark.sparkContext.broadcast(plain(df if queries is None else queries).orderBy(*values, "_key").toArrow().combine_chunks())
    every, m, to = queries is None, len(numbers), df.schema[key].dataType.simpleString()

    def pairs(batches):
        q = asked.value.to_batches()
        if not q:
            return
        sets = [c.drop_null().unique() for c in q[0].columns[1 + m:]]
        ask = list(_blocks(q[0].column(0), *_coded(q[0], m, sets)))
        for batch in batches:
            for there, b, b_at in _blocks(batch.column(0), *_coded(batch, m, sets)):
                for keys, a, a_at in ask:
                    s = _gower(a, b, spans)
                    lost = np.isnan(s).any()
                    s = s[a_at].take(b_at, axis=1).ravel()
                    i, j = keys.take(pa.array(np.repeat(np.arange(len(keys)), len(there)))), there.take(pa.array(np.tile(np.arange(len(there)), len(keys))))
                    out = pa.RecordBatch.from_arrays([i, j, pa.array(s, mask=np.isnan(s) if lost else None)], ["i", "j", "s"])
                    if every:
                        out = out.filter(pc.less(i, j))
                    elif pc.any(pc.is_in(keys, value_set=there)).as_py():
                        out = out.filter(pc.not_equal(i, j))
                    yield out

    # a task has few keys, which take few bits each; its rows differ little
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-rows // GOWER_TASK))
    return plain(df).repartitionByRange(parts, *values, "_key").sortWithinPartitions(*values, "_key").mapInArrow(pairs, f"i {to}, j {to}, s double")


def kernel_2d(df: DataFrame, x: str, y: str, z: Column, xs: Sequence[float], ys: Sequence[float], sx: float, sy: float) -> DataFrame:
    """Gaussian-weighted mean of z at each point of a small grid, in one pass over the rows."""
    rows = []
    for gx in xs:
        for gy in ys:
            w = F.exp(-0.5 * (F.pow((F.col(x) - gx) / sx, 2) + F.pow((F.col(y) - gy) / sy, 2)))
            rows.append(F.struct(F.lit(float(gx)).alias("gx"), F.lit(float(gy)).alias("gy"), (F.sum(w * z) / F.sum(w)).alias("z")))
    return df.agg(F.array(*rows).alias("_a")).select(F.inline("_a"))


def rank_against(df: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str) -> DataFrame:
    """Percentile rank of each value within a reference column: distinct values of both are merged in one order."""
    ref = reference.filter(F.col(ref_value).isNotNull()).groupBy(F.col(ref_value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    both = ref.unionByName(df.select(F.col(value).alias("_v")).filter("_v is not null").distinct().withColumn("_n", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    pr = running(both, [], "_v", {"_upto": ("sum", F.col("_n"))}, totals={"_all": F.col("_n")}).select("_v", (100 * (F.col("_upto") - F.col("_n") / 2) / F.col("_all")).alias(out))
    return df.join(pr, F.col(value) == F.col("_v"), "left").drop("_v")


def positions(df: DataFrame, value: str, table: DataFrame, table_value: str, out: str) -> DataFrame:
    """How many table values are at or below each value."""
    t = table.groupBy(F.col(table_value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    both = t.unionByName(df.select(F.col(value).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    pos = running(both, [], "_v", {out: ("sum", F.col("_n"))}).select("_v", out)
    return df.join(pos, F.col(value) == F.col("_v"), "left").drop("_v")


def interpolate(df: DataFrame, value: str, points: Sequence[tuple[float, float]], out: str) -> DataFrame:
    """Piecewise linear map through a few points, held beyond them; missing stays missing."""
    x, e = F.col(value), F.lit(float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        e = F.when(x > x0, y0 + (F.least(x, F.lit(x1)) - x0) * (y1 - y0) / (x1 - x0)).otherwise(e)
    return df.withColumn(out, F.when(x.isNotNull(), e))


def _one(t, rows: list[tuple], schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(rows, schema)


def bhattacharyya(t) -> DataFrame:
    """Gaussian distance of two classes of lines by quantity, price and tax."""
    a, b = sorted((m for m in moments(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], ["l_linestatus"])), key=lambda m: m["l_linestatus"])[:2]
    s, d = (a["cov"] + b["cov"]) / 2, a["mean"] - b["mean"]
    logs = [np.linalg.slogdet(x)[1] for x in (s, a["cov"], b["cov"])]
    return _one(t, [(float(d @ np.linalg.solve(s, d) / 8 + (logs[0] - (logs[1] + logs[2]) / 2) / 2),)], "distance double")


def kl_similarity(t) -> DataFrame:
    """exp of minus the symmetric divergence of normal densities fitted to each pair of segments."""
    m = moments(t("customer"), ["c_acctbal"], ["c_mktsegment"])
    rows = []
    for a in m:
        for b in m:
            if a["c_mktsegment"] < b["c_mktsegment"]:
                (ma, va), (mb, vb) = ((float(x["mean"][0]), float(x["cov"][0, 0])) for x in (a, b))
                kl = lambda p, v, q, w: 0.5 * (np.log(w / v) + (v + (p - q) ** 2) / w - 1)
                rows.append((a["c_mktsegment"], b["c_mktsegment"], float(np.exp(-(kl(ma, va, mb, vb) + kl(mb, vb, ma, va))))))
    return _one(t, rows, "a string, b string, similarity double")


def mahalanobis(t) -> DataFrame:
    """Distance of each part from the centre of all; the inverse covariance enters the plan as constants."""
    cols = ["p_size", "p_retailprice"]
    m = moments(t("part"), cols)[0]
    inv = np.linalg.pinv(m["cov"])
    d = [F.col(c) - float(v) for c, v in zip(cols, m["mean"], strict=True)]
    q = sum(float(inv[i, j]) * d[i] * d[j] for i in range(2) for j in range(2))
    return t("part").select("p_partkey", F.round(F.sqrt(q), 6).alias("distance"))


def randomised_dependence(t, k: int = 10, s: float = 0.5, seed: int = 1) -> DataFrame:
    """Copula ranks, random sine features, largest canonical correlation; feature moments are summed where rows lie."""
    x = stats.tied_rank(stats.tied_rank(t("part"), [], "p_size", "_a"), [], "p_retailprice", "_b")
    n = t("part").count()
    r = np.random.default_rng(seed)
    w = r.normal(0, s, (2, k, 2))

    def sums(batches):
        total, count = np.zeros((2 * k + 1, 2 * k + 1)), 0
        for p in batches:
            f = [np.sin(np.outer(p[c].to_numpy() / n, w[i, :, 0]) / s + w[i, :, 1]) for i, c in enumerate(("_a", "_b"))]
            z = np.hstack([np.ones((len(p), 1)), *f])
            total += z.T @ z
            count += len(p)
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = x.select("_a", "_b").mapInPandas(sums, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    m = np.zeros((2 * k + 1) ** 2)
    for p in parts:
        m[p["pos"]] = p["v"]
    m = m.reshape(2 * k + 1, -1)
    mean = m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / m[0, 0] - np.outer(mean, mean) + 1e-8 * np.eye(2 * k)
    a, b, ab = c[:k, :k], c[k:, k:], c[:k, k:]
    ev = np.linalg.eigvals(np.linalg.solve(a, ab) @ np.linalg.solve(b, ab.T)).real.max()
    return _one(t, [(float(np.sqrt(np.clip(ev, 0, 1))),)], "rdc double")


def kernel_density(t, bins: int = 256) -> DataFrame:
    """Gaussian density on a grid from binned counts, with Silverman's width."""
    df = t("orders")
    s = df.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.stddev_samp("o_totalprice").alias("sd"), F.count("o_totalprice").alias("n")).first()
    step = (s["hi"] - s["lo"]) / (bins - 1)
    counts = df.groupBy(F.round((F.col("o_totalprice") - s["lo"]) / step).cast("int").alias("b")).count().collect()  # at most `bins` rows
    x, h = s["lo"] + step * np.arange(bins), 1.06 * s["sd"] * s["n"] ** -0.2
    w = np.zeros(bins)
    for r in counts:
        w[r["b"]] = r["count"]
    d = (np.exp(-0.5 * ((x[:, None] - x[None]) / h) ** 2) * w).sum(1) / (s["n"] * h * np.sqrt(2 * np.pi))
    return _one(t, [(float(a), float(b)) for a, b in zip(x, d, strict=True)], "x double, density double")


def knee(y: np.ndarray, x: np.ndarray) -> int:
    """Index at which two straight lines fit a curve best."""
    def sse(u, v):
        if len(u) < 2:
            return 0.0
        p = np.polyfit(u, v, 1)
        return float(((np.polyval(p, u) - v) ** 2).sum())

    return int(np.argmin([sse(x[: k + 1], y[: k + 1]) + sse(x[k:], y[k:]) for k in range(1, len(x) - 1)]) + 1)


def knee_point(t) -> DataFrame:
    """Elbow of the brands' counts, ordered."""
    n = sorted((r["count"] for r in t("part").groupBy("p_brand").count().collect()), reverse=True)
    k = knee(np.cumsum(n).astype(float), np.arange(len(n), dtype=float)) if len(n) > 2 else 0
    return _one(t, [(k, float(n[k]))], "index int, value double")


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of clusters by mean distance; new clusters are numbered from len(d)."""
    n, d = len(d), d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), [1] * n, []
    while len(ids) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(d[i, j]), sizes[i] + sizes[j]))
        row = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i], sizes[i] = n + len(out) - 1, sizes[i] + sizes[j]
        del ids[j], sizes[j]
    return out


def linkage(t) -> DataFrame:
    """Average linkage of the nations by mean balance and number of customers."""
    rows = t("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("c_nationkey").collect()  # a row for each nation
    x = np.array([[r["a"], r["n"]] for r in rows], float)
    x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return _one(t, average_linkage(d), "a int, b int, height double, size int")
