import random

import numpy as np
import sentencepiece

from tablewright.llm import pieces as p

TEXTS = [None, "", " ", "a", "  two  spaces ", "tabs\tand\nlines\n", "é漢字🎉 ü\x00", "word " * 3000, "x" * 2000, "Hello, world! It's 2024."]


def brute(c, w):
    """Best score of a word over all ways to cut it."""
    best = [0.0] + [-1e18] * len(w)
    for e in range(1, len(w) + 1):
        best[e] = best[e - 1] + c.unknown
        for s in range(e):
            if w[s:e] in c.score:
                best[e] = max(best[e], best[s] + c.score[w[s:e]][0])
    return best[-1]


def worth(c, w, raw):
    ids, total, at, k = np.frombuffer(raw, "<u4").tolist(), 0.0, 0, 0
    while k < len(ids):
        if ids[k] in c.of_byte:
            k += len(w[at].encode())
            total += c.unknown
            at += 1
        else:
            total += c.score[c.pieces[ids[k]]][0]
            at += len(c.pieces[ids[k]])
            k += 1
    assert at == len(w)
    return total


def test_shared_prefixes_give_the_best_cut():
    c, r = p.Codec(p.model_path()), random.Random(3)
    words = {"▁" + "".join(r.choice("aestrin") for _ in range(r.randrange(1, 12))) + r.choice(["", "é", "🎉", ",", "ing"]) for _ in range(400)}
    for w, raw in c.words(list(words)).items():
        assert abs(worth(c, w, raw) - brute(c, w)) < 1e-3, w


def test_round_trip(spark, sf):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (3, "a", 3)], "doc_id long, text string, ids int")
    rows = p.digest(df, p.model_path()).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    c = p.codec(p.model_path())
    for r in p.encode(df, p.model_path()).collect():
        if r.doc_id is not None:
            assert c.decode(r.ids) == (TEXTS[r.doc_id] or "")
    assert p.digest(df.limit(0), p.model_path()).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert p.digest(docs, p.model_path()).filter("not round_trip").count() == 0


def test_decodes_what_the_library_encodes():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=p.model_path()), p.codec(p.model_path())
    for t in TEXTS:
        if t:
            assert c.decode(sp.encode(t)) == sp.decode(sp.encode(t)) or c.decode(sp.encode(t)) == t
            assert sp.decode(np.frombuffer(c.encode([t])[0], "<u4").tolist()) == sp.decode(sp.encode(t))
