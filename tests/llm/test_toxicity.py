import numpy as np

from tablewright.llm import toxicity as t
from tablewright.llm.queries import op3_toxicity

from .test_quality_classifier import auc


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = t.fresh(np.zeros(0, np.uint64))
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = np.vstack([rng.normal(size=(5, t.WORD_DIM + t.CHAR_DIM)), np.zeros((1, t.WORD_DIM + t.CHAR_DIM))])
    at = rng.integers(0, 6, (3, 7))
    t32 = {k: v.astype(np.float32) for k, v in w.items()}
    _, cache = t.forward(t32, x.astype(np.float32), at, keep=True)
    g, d_x = t.backward(t32, x.astype(np.float32), at, cache, np.ones(3, np.float32))
    for k in ("f_in", "b_rec", "f_b", "att_w", "att_v", "out"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = (dict(t32, **{k: t32[k].copy()}) for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        want = (t.forward(up, x.astype(np.float32), at).sum() - t.forward(down, x.astype(np.float32), at).sum()) / 2e-2
        assert abs(want - g[k][i]) < 0.03 * max(1, abs(want)), k
    up, down = x.copy(), x.copy()
    up[0, 3] += 1e-2
    down[0, 3] -= 1e-2
    want = (t.forward(t32, up.astype(np.float32), at).sum() - t.forward(t32, down.astype(np.float32), at).sum()) / 2e-2
    assert abs(want - d_x[0, 3]) < 0.03 * max(0.3, abs(want))


def test_windows_cover_every_word():
    for n in (0, 1, 6, 18, 24, 25, 42, 43, 1000):
        at, of = t.windows(np.zeros(n, int), 1)
        assert set(at[at >= 0]) == set(range(n)) and len(of) == len(at) >= 1


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.7
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    assert got[got.toxic == 0].predicted.mean() < 0.1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you idiot", 1), (4, "a b c " * 9000, 1), (3, "you idiot", 1), (None, "x", 1)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in t.classify(docs, none).collect()} == {0.5}
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (9, 1)], "doc_id long, label int")
    rows = t.classify(docs, both).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id == 3]
    assert same[0] == same[1]
    assert t.classify(docs.limit(0), both).count() == 0


def test_late_words_are_scored(spark):
    """A toxic passage at the end of a very long text counts."""
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(["sun", "rain", "tree", "house", "river", "stone", "green"], 60)) for _ in range(200)]
    texts = [x + (" what an idiot clown" if i % 3 == 0 else "") for i, x in enumerate(plain)]
    net = t.train(texts, [int(i % 3 == 0) for i in range(200)], epochs=12)
    odds = t.log_odds(net, *t._buffer(["rain tree " * 5000, "rain tree " * 5000 + "IDIOT!! clown*** sun"]))
    assert odds[1] > odds[0] + 2
