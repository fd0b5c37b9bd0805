import zlib

import corpus_pipeline as c
from tablewright.llm import packing
from tablewright.llm.common import table

from .test_ngram_join import brute as components
from .test_packing import check
from .test_substring_dedup import brute as cuts


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = [docs]
    for name, stage in c.STAGES:
        outs.append(table(stage(spark, outs[-1], sf), name))
    rows = [x.collect() for x in outs]
    for a, b in zip(outs[:4], outs[1:5]):
        assert b.columns == a.columns
    # models: a document goes if its score says so, and almost all good, clean ones stay
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[1]}
    good = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert not [i for i, r in labels.items() if r.quality == 0 and i in kept and zlib.crc32(str(i).encode()) % 5][3:]
    clean = [r for r in rows[1] if r.doc_id in labels and labels[r.doc_id].toxic == 0]
    assert sum(r.doc_id in {x.doc_id for x in rows[2]} for r in clean) >= 0.9 * len(clean)
    # near copies
    want = [i for i, n, root in components([(r.doc_id, r.text) for r in rows[2]], 5, 80) if i == root or not n]
    assert sorted(r.doc_id for r in rows[3]) == want
    # repeated bytes
    removed = {i: (n, gone) for i, n, gone, _, _ in cuts([(r.doc_id, r.text) for r in rows[3]])}
    assert sorted(r.doc_id for r in rows[4]) == sorted(removed)
    for r in rows[4]:
        n, gone = removed[r.doc_id]
        assert n - gone - 3 * 20 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
    # packing
    check(rows[5], [(r.doc_id, r.text) for r in rows[4]], packing.CAPACITY)


def test_repeated_rows_and_nulls(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (2, None, "en", "s", 0), (None, "A b c d e f", None, None, None), (5, "x y", "en", "s", 3), (5, "other words", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    one = [(r.doc_id, r.text) for r in c.keep_one_of_near_copies(spark, docs, sf).collect()]
    assert sorted(one, key=str) == sorted([(1, "a b c d e f"), (2, None), (5, "x y"), (5, "other words")], key=str)
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_take_odd_rows_and_clashing_names(spark):
    """Null ids and texts, repeated rows, an id of 2**63 - 1, and columns named as the operators name theirs."""
    sf = "/root/testdata/sf0.001"
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    text = real[0][1]
    rows = [*real, (None, text), (None, None), (-5, None), (2**63 - 1, real[1][1]), real[2], real[2], (10**9, ""), (10**9 + 1, text * 300)]
    names = ["k", "t", "row", "doubt", "stays", "nth", "size", "cls", "_rest", "_k", "a b", "bucket", "rank", "score", "stats"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", None, *range(len(names))) for i, t in rows], schema)
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        got = out.collect()
        if k == len(c.STAGES) - 1:
            assert sum(r.piece == 0 for r in got) == len(rows)
            continue
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in got), name
        if name == "suffix_dedup":
            assert len(got) == len(rows)
        elif name == "ngram_join":
            assert len([r for r in got if r.doc_id == real[2][0]]) <= 1 and sum(not r.text for r in got) == 3
            assert not [r for r in got if r.doc_id is None and r.text]
        else:
            assert {r.doc_id for r in got} <= {i for i, _ in rows}
