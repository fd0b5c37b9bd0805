import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import lm_scoring as m
from tablewright.llm.queries import op10_lm_scoring


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50) | st.integers(0, 50), max_size=200), st.lists(st.integers(0, 2**50) | st.integers(0, 60), min_size=1, max_size=30))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.uint64)
    e = m.EliasFano(v)
    assert (e.access(np.arange(len(v))) == v).all()
    q = np.array(asked, np.uint64)
    at, hit = e.next_geq(q, np.zeros(len(q), np.int64), np.full(len(q), len(v)))
    assert (at == np.searchsorted(v, q)).all() or all(h for h, x in zip(hit, q, strict=True) if x in v)
    assert hit.tolist() == [x in set(v.tolist()) for x in q.tolist()]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")), None]


def brute(rows):
    """rows: id, text, train. The exact model, without quantised codes."""
    uni, pair, context = Counter(), Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = tokens(text)
            uni.update(t)
            pair.update(zip(t, t[1:]))
            context.update(t[:-1])
    types = Counter(a for a, _ in pair)
    n, v = sum(uni.values()), len(uni)
    p = lambda w: math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1)))
    out = []
    for i, text, train in rows:
        t = tokens(text)
        score = p(t[0])
        for a, b in zip(t, t[1:]):
            if pair[a, b]:
                score += math.log10((pair[a, b] - 0.75) / context[a])
            else:
                score += (math.log10(0.75 * types[a] / context[a]) if context[a] else 0) + p(b)
        out.append((i, not train, len(t), sum(uni[w] > 0 for w in t), n, sum(map(p, t)), score))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5])), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < 0.02 * max(1, w[2]), (g, w)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in docs])
    same([tuple(r) for r in op10_lm_scoring(spark, sf).collect()], want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b a b A B"), (3, "a b a b A B"), (3, "c"), (4, " \n x\x0by "), (5, "the the the " * 3000), (6, "a b unseen words é"), (7, "b a"), (None, "a"), (8, "the end the x")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, k int, t string")
    got = m.score(df, ~F.col("doc_id").isin(6, 7, 1, 8)).collect()
    same([tuple(r) for r in got], brute([(i, t, i not in (6, 7, 1, 8)) for i, t in rows]))
    assert m.score(df.limit(0), F.lit(True)).count() == 0
    nothing = m.score(df, F.lit(False)).collect()
    assert len(nothing) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
