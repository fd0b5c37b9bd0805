"""Similarities of array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 - sqrt(2 - 2 cos) / 2."""
    return 1 - F.sqrt(F.greatest(2 - 2 * cosine(a, b), F.lit(0.0))) / 2


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a)
    sa, sb = total(F.transform(a, lambda x: x.cast("double"))), total(F.transform(b, lambda x: x.cast("double")))
    return (n * dot(a, b) - sa * sb) / (F.sqrt(n * dot(a, a) - sa * sa) * F.sqrt(n * dot(b, b) - sb * sb))


def total_kl(a: Column, b: Column) -> Column:
    """Total Kullback-Leibler divergence of two positive vectors, each scaled to sum 1."""

    def share(x: Column) -> Column:
        whole = total(F.transform(x, lambda u: u.cast("double")))
        return F.transform(x, lambda v: v.cast("double") / whole)

    p, q = share(a), share(b)
    kl = total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)))
    return kl / F.sqrt(1 + total(F.transform(q, lambda y: y * F.pow(1 + F.ln(y), 2))))
