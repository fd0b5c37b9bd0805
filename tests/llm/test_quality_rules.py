import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(wins)
    hit = {j for i, x in enumerate(wins) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


CASES = [None, "", "   ", "a", "a b", "a b c", "a a a a a", "x y z x y z\nq\nq\n \n \n", "é#*$ %&|<> é\x0b\x0cé", "the cat sat the cat sat on the cat sat " * 500, "word " * 60, "a b c a b c"]


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(CASES)], SCHEMA)
    got = {r.doc_id: r for r in q.measures(df).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in q.apply(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        g, b = got[r.doc_id], brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b
        assert g.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (g.base_failed and g.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    able = [i for i in good if not got[i].base_failed]
    assert sum(got[i].kept for i in able) >= 0.95 * len(able)


def test_empty_nulls_and_repeats(spark):
    assert q.apply(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = q.apply(spark.createDataFrame([(None, "a b"), (3, None), (3, None), (4, "w " * 80)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and all(r.base_failed for r in rows)


@settings(max_examples=20)
@given(st.lists(st.tuples(st.tuples(*[st.sampled_from([-1, 0, 1])] * 7), st.integers(1, 1000)), min_size=1, max_size=20))
def test_em_gives_probabilities(counts):
    p, good, bad = q.fit(counts)
    assert 0 < p < 1
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in good + bad)


def test_posteriors_match_brute_force(spark, sf):
    """Expectation-maximisation over documents one by one, in numpy, against the patterns' counts."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in q.apply(docs).collect()}
    rows = q.votes(q.measures(docs)).collect()
    v = np.array([[r[n] for n in q.RULES] for r in rows])
    start = np.array([[0.6, 0.3, 0.1], [0.2, 0.3, 0.5]])  # vote 1, 0, -1 of good and bad documents
    rate, p = np.repeat(start[:, None], v.shape[1], 1), 0.85
    hot = np.stack([v == k for k in (1, 0, -1)], 2).astype(float)
    for _ in range(100):
        x = np.log(p) - np.log(1 - p) + (hot * np.log(rate[0] / rate[1])).sum((1, 2))
        post = 1 / (1 + np.exp(-x))
        new = np.stack([(hot * w[:, None, None]).sum(0) + 10 * s for w, s in ((post, start[0]), (1 - post, start[1]))])
        moved = np.abs(new / new.sum(2, keepdims=True) - rate).max()
        rate, p = new / new.sum(2, keepdims=True), (post.sum() + 8.5) / (len(v) + 10)
        if moved < 1e-7:
            break
    x = np.log(p) - np.log(1 - p) + (hot * np.log(rate[0] / rate[1])).sum((1, 2))
    for r, want in zip(rows, 1 / (1 + np.exp(-x)), strict=True):
        g = got[r.doc_id]
        assert abs(g.p_good - want) < 1e-4
        assert g.kept == (not g.base_failed and g.p_good >= 0.5)
