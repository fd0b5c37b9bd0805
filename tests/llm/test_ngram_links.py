import random
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import ngram_join as g
from tablewright.llm import prefix_trie as t
from tablewright.llm import queries

from .test_ngram_join import edit, sets


def brute(rows, n=4, percent=85):
    """doc_id, class_id, n_links: least id of equal sets (its own for an empty one), and the number of other sets at the threshold or above."""
    s = {i: sets(t, n) for i, t in rows}
    least = {}
    for i in sorted(s):
        least.setdefault(s[i], i)
    every = [x for x in least if x]
    links = Counter(a for a in every for b in every if a != b and 100 * len(a & b) >= percent * len(a | b))
    return sorted((i, least[s[i]] if s[i] else i, links[s[i]]) for i in s)


def run(df, **k):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in g.join(df, **k).collect()), key=str)


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for size in (60, 90):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(70):
            w = edit(r, base, r.choice([0, 1, 1, 2, 4]))
            rows.append((len(rows), " ".join(w[r.randrange(3) :] if r.random() < 0.3 else w)))
    rows += [(len(rows) + i, " ".join(r.choice(vocab) for _ in range(50))) for i in range(10)] + [(900, ""), (901, rows[0][1])]
    return rows


@pytest.mark.parametrize("k", [{}, {"star": 2}, {"star": 2, "block": 16}])
def test_links_match_brute_force(spark, near_copies, k):
    df = spark.createDataFrame(near_copies, "doc_id long, text string")
    assert run(df, **k) == sorted(brute(near_copies), key=str)


def test_blocks_by_shingles(spark, near_copies):
    df = spark.createDataFrame(near_copies + near_copies[:3], "doc_id long, text string")
    assert set(run(df, star=4, per_tree=250)) == set(brute(near_copies))


def test_query_returns_links(spark, sf):
    got = queries.op4_ngram_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "class_id", "component_id", "n_links"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


def test_largest_id_is_no_null(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(2**63 - 1, text), (None, text), (2**63 - 1, "other words"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in g.join(df).collect()), key=str)
    top = 2**63 - 1
    assert got == sorted([(top, 4, top, top), (None, 4, top, top), (top, 1, top, top), (None, 0, None, None)], key=str)


def made_sets(r, many, size, vocab, edits):
    base = r.sample(range(vocab), size)
    out = []
    for _ in range(many):
        x = set(base)
        for _ in range(r.randrange(edits)):
            x.discard(r.choice(sorted(x)))
            x.add(r.randrange(vocab))
        out.append(sorted(x))
    return out


def as_sets(lists, group):
    return t.Sets(np.array(group), np.array([len(x) for x in lists]), np.concatenate([np.array(x) for x in lists]), np.r_[0, np.cumsum([len(x) for x in lists])])


def test_walk_matches_brute_force_and_cuts_subtrees():
    r = random.Random(8)
    lists = [x for _ in range(12) for x in made_sets(r, 15, r.randrange(5, 90), 400, 8)]
    group = [0] * len(lists)
    walk = t.Walk(as_sets(lists, group), None, 80)
    got = {(i, int(j)) for i, js in walk.found() for j in js}
    sets_ = [set(x) for x in lists]
    want = {(i, j) for i, a in enumerate(sets_) for j, b in enumerate(sets_) if i != j and 100 * len(a & b) >= 80 * len(a | b)}
    assert got == want and want
    assert walk.cut > 10 and walk.nodes < 2 * len(lists)
    # against other probes, and only within groups
    halves = [i % 2 for i in range(len(lists))]
    two = t.Walk(as_sets(lists, halves), as_sets(lists[::-1], halves[::-1]), 80)
    n = len(lists) - 1
    assert {(i, n - int(j)) for i, js in two.found() for j in js} == {(i, j) for i, j in want if halves[i] == halves[j]} | {(i, i) for i in range(n + 1)}


def test_work_in_a_group_of_copies_is_shared():
    """Sets that share a long path add it up once: the tree has far fewer tokens on its edges than the sets."""
    lists = [list(range(200)) + [300 + i] for i in range(100)]
    walk = t.Walk(as_sets(lists, [0] * 100), None, 80)
    steps = []
    add = walk._overlap
    walk._overlap = lambda path: steps.append(len(path)) or add(path)
    assert sum(len(j) for _, j in walk.found()) == 100 * 99
    assert sum(steps) <= 200
