import hashlib
import random

import numpy as np

from tablewright.llm import substring_dedup as s
from tablewright.llm.queries import op8_suffix_dedup


def brute(rows, span=50):
    """n_bytes, n_removed, n_spans, sha of each row, by sets of strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        key = float("inf") if i is None else i
        for p in range(len(t) - span + 1):
            w = t[p : p + span]
            first[w] = min(first.get(w, float("inf")), key)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        key = float("inf") if i is None else i
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < key:
                gone[p : p + span] = True
        runs = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def run(df, span=50):
    return sorted(((r._rest.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(df, span).collect()), key=str)


def test_matches_brute_force_on_made_texts(spark):
    r = random.Random(4)
    blocks = ["".join(r.choice("abé ") for _ in range(n)) for n in (49, 50, 51, 60, 75, 100, 33, 200)] + ["x" * 120, "ab" * 70]
    rows = [(i, "".join(r.choice(blocks) if r.random() < 0.6 else "".join(r.choice("abcdefgh \n") for _ in range(r.randrange(60))) for _ in range(r.randrange(6)))) for i in r.sample(range(1000), 60)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 49), (5003, "a" * 50), (5004, "a" * 50), (5005, "a" * 4000), (5006, rows[0][1]), (5006, rows[0][1]), (5006, rows[1][1] + "tail"), (None, rows[2][1]), (None, rows[2][1]), (-7, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, k int, lo string")
    assert run(df) == brute(rows)
    assert run(df, 64) == brute(rows, 64)
    assert s.dedup(df.limit(0)).count() == 0


def test_matches_brute_force_on_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op8_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_long_spans_and_odd_names(spark):
    """Spans whose windows lie more than 255 bytes apart, a clashing column with a space, rows in tasks of their own."""
    r = random.Random(9)
    end = "".join(r.choice("abcdefgh ") for _ in range(1500))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(900))) + end[r.randrange(300) :]) for i in range(24)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _k int, _rest int, `a b` int").repartition(24)
    for span in (50, 270, 400, 600, 700):
        assert run(df, span) == brute(rows, span), span


def test_a_text_longer_than_a_chunk(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh \n") for _ in range(s.CHUNK + 5000))
    rows = [(1, "x" + long[:4000]), (2, long), (3, long[300_000:300_200] + "z"), (4, long)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert [x[2] for x in got] == [0, 4000, 200, len(long)] and [x[3] for x in got] == [0, 1, 1, 1]
