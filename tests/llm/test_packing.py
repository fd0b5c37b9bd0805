import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import packing as p

TEXTS = [None, "", " ", "a", "Hello  world", "it's we'll 'said '", "tabs\t and\n\n newlines \n x", "end <|endoftext|> here", "é ü 漢字 🎉 \x85\x1c x", "x " * 3000, "word" * 900, "a\n b \n c  d", "  lead", "trail  ", "1 2 33 !? .. a.b"]


def test_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(p.vocabulary()), p.encoder(p.vocabulary())
    for x in TEXTS:
        assert np.frombuffer(e(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t'sallreve1.!é漢\x85 -", max_size=60))
def test_ids_match_on_odd_texts(x):
    from tokenizers import Tokenizer

    t = test_ids_match_on_odd_texts.__dict__.setdefault("t", Tokenizer.from_file(p.vocabulary()))
    assert np.frombuffer(p.encoder(p.vocabulary())(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def least(items, cap):
    """Fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for r in {*bins}:
            if r >= items[k]:
                rest = list(bins)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*bins, cap - items[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimum(items):
    count = np.bincount(items, minlength=21) if items else np.zeros(21, int)
    left = count.copy()
    fixed = p.reduce(left, 20)
    rest = [x for x in range(21) for _ in range(left[x])]
    assert sum(n for n, _ in fixed) + least(rest, 20) == least(items, 20)
    whole = p.plan(count, 20)
    used = np.zeros(21, int)
    for n, lengths in whole:
        assert sum(lengths) <= 20
        for x in lengths:
            used[x] += n
    assert (used == count).all()


def check(rows, texts, cap):
    e = p.encoder(p.vocabulary())
    want = {}
    for i, t in texts:
        ids = e(t or "") + np.array([2], "<u4").tobytes()
        want.setdefault(i, []).append(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in want[r.doc_id])
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= cap
    assert sum(r.length for r in rows) == sum(len(x) // 4 for v in want.values() for x in v)
    return seqs


def test_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = p.pack(p.pieces(docs, p.vocabulary()), per_bucket=50).collect()
    seqs = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    total = sum(r.length for r in rows)
    assert len(seqs) <= 1.02 * total / 1024 + 1
    for r in rows:
        assert r.length == 1024 or r.piece == 0


def test_odd_rows(spark):
    texts = [*enumerate(TEXTS), (3, "a"), (3, "a"), (None, "x")]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, length int")
    check(p.pack(p.pieces(df, p.vocabulary())).collect(), texts, 1024)
    assert p.pack(p.pieces(df.limit(0), p.vocabulary())).count() == 0


def test_many_pieces_take_few_steps():
    """What is fixed is fixed for all equal sets at once, however many pieces there are."""
    count = np.zeros(1025, np.int64)
    count[[300, 310, 320, 330, 400, 410]] = 10**9
    fixed = p.reduce(count.copy())
    assert len(fixed) < 100
    whole = p.plan(count)
    used = np.zeros(1025, np.int64)
    for n, lengths in whole:
        used[list(set(lengths))] += [n * lengths.count(x) for x in set(lengths)]
    assert (used == count).all() and len(whole) < 100


def test_clashing_columns_and_hot_length(spark):
    rows = [(i // 3, i % 3, 0, 5 if i % 4 else 700, i, "a", "b", 1, 2, 3) for i in range(900)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, row string, `a b` string, bucket int, rank int, sequence_id int")
    got = p.pack(cut, per_bucket=50).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "row", "a b", "bucket", "rank", "sequence_id", "offset"]
    assert len(got) == 900 and (got["a b"] == "b").all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 1024
