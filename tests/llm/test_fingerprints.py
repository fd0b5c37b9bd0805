import hashlib

from tablewright.llm import fingerprints as f


def test_edits_match_brute_force(spark):
    rows = [(5, "one two three four five six\nseven"), (9, "épée " * 40), (2, ""), (1, None), (7, "abc"), (100, "z" * 5000), (3, "one two three four five six\nseven"), (3, "tie")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, b string")
    got = {(r.doc_id, r.fingerprint): r for r in f.with_next(df, 4).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        r = got[(i, f.of_text(t))]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == f.of_text(edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_multiset():
    a, b = "first paragraph here", "second one, longer than that"
    assert f.of_text(f"{a}\n{b}") == f.of_text(f"{b}\n\n{a}\n")
    assert f.insert(f.of_text(a), b) == f.of_text(f"{a}\n{b}")
    assert f.delete(f.of_text(f"{a}\n{b}\n{a}"), a) == f.of_text(f"{a}\n{b}")
    assert f.of_text(f"{a}\n{a}") != f.of_text(a)
    assert f.of_text(None) == f.of_text("")


def test_likeness_orders_edits(spark, sf):
    rows = [r for r in f.with_next(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)
    assert f.fingerprint(spark.read.parquet(f"{sf}/documents.parquet")).count() == 200


def test_empty_single_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert f.with_next(spark.createDataFrame([], schema)).count() == 0
    one = f.with_next(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert f.with_next(spark.createDataFrame([(None, "abc"), (None, "d"), (4, "xyz")], schema), 4).count() == 3
