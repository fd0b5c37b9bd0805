import numpy as np

from tablewright.llm import quality_classifier as q
from tablewright.llm.queries import op1_quality_classifier


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.9
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    assert got[got.quality == 1].predicted.mean() > 0.95


def test_density_matches_direct_formula():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (200, len(q.NAMES))) for k in (0, 1)}
    m = q.discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 0.3, 0.1)
    z = (x[0][:5] - m.mean) / m.scale
    want = []
    for k in (0, 1):
        c = np.linalg.inv(m.inverses[k].T @ m.inverses[k])
        c = np.linalg.inv(np.linalg.inv(c))
        d = z - m.centres[k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.log_odds(x[0][:5]), want[1] - want[0], atol=1e-6)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "\n\n", "z"), (4, "a b c " * 9000, "z"), (4, "a b", "z"), (None, "x", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in q.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (77, 0)], "doc_id long, label int")
    assert {r.score for r in q.classify(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, label int")
    rows = q.classify(docs, both).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert q.classify(docs.limit(0), both).count() == 0
