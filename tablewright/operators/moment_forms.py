"""Ranks, p-values, matches and synthetic cases that need only class moments or a Gram matrix, summed in one pass over all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .neighbours import hungarian
from .numeric import moments


def gaussian_distance(a: dict, b: dict, at: Sequence[int]) -> float:
    """Bhattacharyya distance of two normal classes on some of the columns; infinite where they are degenerate."""
    ix = np.ix_(at, at)
    s, d = (a["cov"][ix] + b["cov"][ix]) / 2, (a["mean"] - b["mean"])[list(at)]
    (g0, l0), (g1, l1), (g2, l2) = (np.linalg.slogdet(x) for x in (s, a["cov"][ix], b["cov"][ix]))
    if min(g0, g1, g2) <= 0:
        return float("inf")
    return float(d @ np.linalg.solve(s, d) / 8 + (l0 - (l1 + l2) / 2) / 2)


def bhattacharyya_rank(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, weight: one over the distance of the two classes without the feature. Rows without a label or a value are left out."""
    by = sorted(moments(df.dropna(subset=[label]), columns, [label]), key=lambda m: m[label])
    if len(by) != 2:
        raise ValueError(f"two labels wanted, not {len(by)}")
    rows = []
    for i, c in enumerate(columns):
        d = gaussian_distance(*by, [j for j in range(len(columns)) if j != i])
        rows.append((c, 1 / d if d > 0 else float("inf")))
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def analytic_p(df: DataFrame, columns: Sequence[str], label: str, positive, weights: Sequence[float]) -> DataFrame:
    """feature, p: the closed form for weights of a linear machine under permuted labels (two-sided, normal).

    The map from labels to weights has rows that sum to 0, so their null mean is 0; its products follow from the columns' Gram matrix
    and sums alone, whatever the number of rows. A weight without spread has p 0 unless it is 0.
    """
    full = df.dropna(subset=[*columns, label])
    m, share = moments(full, columns)[0], full.agg(F.avg((F.col(label) == F.lit(positive)).cast("double"))).first()[0]
    s = m["n"] * m["mean"]
    g = (m["n"] - 1) * m["cov"] + m["n"] * np.outer(m["mean"], m["mean"])
    inv = np.linalg.pinv(g, hermitian=True)
    u, v = inv @ s, inv @ inv @ s
    a = inv - np.outer(u, v) / max(s @ v, 1e-300)
    spread = np.sqrt(np.maximum(np.diag(a @ g @ a.T), 0) * (4 * share - 4 * share**2))
    w = np.asarray(weights, float)
    z = np.abs(w / np.linalg.norm(w)) / np.maximum(spread / max(np.linalg.norm(spread), 1e-300), np.finfo(float).tiny)
    return df.sparkSession.createDataFrame([(c, 2 * special.normal_cdf(-float(x))) for c, x in zip(columns, z, strict=True)], "feature string, p double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    cov = moments(df, columns)[0]["cov"]
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def match_components(df: DataFrame, components: Sequence[str], references: Sequence[str], least: float = 0.0) -> DataFrame:
    """reference, component, similarity, sign: the one-to-one match of largest summed |correlation|; those below `least` stay unmatched (null component)."""
    n = len(references)
    r = correlation_matrix(df, [*references, *components])[:n, n:]
    flip = len(components) < n
    at = hungarian(-np.abs(r.T if flip else r))
    pairs = {int(j): i for i, j in enumerate(at)} if flip else {i: int(j) for i, j in enumerate(at)}
    rows = []
    for i, ref in enumerate(references):
        j = pairs.get(i)
        ok = j is not None and abs(r[i, j]) >= least
        rows.append((ref, components[j], float(abs(r[i, j])), 1 if r[i, j] >= 0 else -1) if ok else (ref, None, None, None))
    return df.sparkSession.createDataFrame(rows, "reference string, component string, similarity double, sign int")


def merge_references(df: DataFrame, references: Sequence[str], threshold: float = 0.85, counts: Sequence[float] | None = None) -> DataFrame:
    """reference, kept, count, weight: greedy merges of the most alike columns (|correlation|) until none reach the threshold.

    The later column joins the earlier one as their mean by counts, flipped where they oppose each other, at length one; weight is what each
    column adds to the kept one. Columns are linear in the old ones all along, so moments of all rows are enough.
    """
    m = moments(df, references)[0]
    gram = (m["n"] - 1) * m["cov"] + m["n"] * np.outer(m["mean"], m["mean"])
    n = len(references)
    t, count, into, active = np.eye(n), np.array(counts if counts is not None else np.ones(n), float), list(range(n)), list(range(n))
    while len(active) > 1:
        c = t.T @ m["cov"] @ t
        sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
        r = c / np.outer(sd, sd)
        best, i, j = max((abs(r[i, j]), -i, -j) for x, i in enumerate(active) for j in active[x + 1 :])
        i, j = -i, -j
        if best < threshold:
            break
        both = count[i] + count[j] or 1.0
        new = (count[i] * t[:, i] + count[j] * (1 if r[i, j] >= 0 else -1) * t[:, j]) / both
        length = np.sqrt(max(new @ gram @ new, 0))
        t[:, i], count[i] = new / length if length else new, both
        active.remove(j)
        into = [i if k == j else k for k in into]
    return df.sparkSession.createDataFrame([(c, references[into[k]], float(count[into[k]]), float(t[k, into[k]])) for k, c in enumerate(references)], "reference string, kept string, count double, weight double")


def component_cases(df: DataFrame, columns: Sequence[str], n: int, seed: int = 0, few: int = 10) -> DataFrame:
    """id and columns of n synthetic cases: independent normal scores of all principal components with the data's spreads, mapped back.

    A column of fewer than `few` distinct values takes the nearest of them.
    """
    m = moments(df, columns)[0]
    value, vector = np.linalg.eigh(m["cov"])
    spread = np.sqrt(np.maximum(value, 0))
    scores = df.sparkSession.range(n).withColumns({f"_s{j}": F.randn(seed + j) * float(spread[j]) for j in range(len(columns))})
    kinds = df.select(F.array(*(F.approx_count_distinct(c) for c in columns)).alias("k")).first()["k"]
    out = scores
    for i, c in enumerate(columns):
        x = sum((F.col(f"_s{j}") * float(vector[i, j]) for j in range(len(columns))), F.lit(float(m["mean"][i])))
        known = sorted(float(r[0]) for r in df.select(c).dropna().distinct().limit(few).collect()) if kinds[i] < 2 * few else []
        if known and len(known) < few:
            x = F.array_min(F.array(*(F.struct(F.abs(F.lit(v) - x).alias("d"), F.lit(v).alias("v")) for v in known)))["v"]
        out = out.withColumn(c, x)
    return out.select("id", *columns)


def probabilistic_map(m: dict, k: int) -> tuple[np.ndarray, float]:
    """Map of centred rows to the posterior means of k factors, and the noise: the maximum of the likelihood that EM climbs to."""
    value, vector = np.linalg.eigh(m["cov"])
    value, vector = value[::-1], vector[:, ::-1]
    noise = float(np.maximum(value[k:], 0).mean()) if k < len(value) else 0.0
    w = vector[:, :k] * np.sqrt(np.maximum(value[:k] - noise, 0))
    return w @ np.linalg.inv(w.T @ w + noise * np.eye(k) + 1e-12 * np.eye(k)), noise
