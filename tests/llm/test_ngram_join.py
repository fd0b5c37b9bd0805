import random
import re

from tablewright.llm import ngram_join as g
from tablewright.llm.components import components


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n=4, percent=85):
    s = {i: sets(t, n) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = s[i], s[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s[i]), find(i)) for i in ids)


def run(df, **k):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in g.join(df, **k).collect())


def edit(r, words, times):
    w = list(words)
    for _ in range(times):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return w


def test_matches_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    boiler = [r.choice(vocab) for _ in range(40)]
    rows, i = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 7)):
            w = edit(r, base, r.randrange(4))
            if r.random() < 0.5:
                w = boiler + w if r.random() < 0.5 else w + boiler
            rows.append((r.randrange(10**6) * 300 + i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
            i += 1
    common = [r.choice(vocab) for _ in range(60)]
    for _ in range(60):  # a group of near copies, some further off
        rows.append((r.randrange(10**6) * 300 + i, "\n".join(edit(r, common, r.choice([0, 1, 1, 2, 9])))))
        i += 1
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (8, "a b c"), (9, "a\tb\x0bc"), (10, "é É"), (11, "x " * 5000), (12, "x x x x")]
    df = spark.createDataFrame([(i, t, 3, "s") for i, t in rows], "doc_id long, text string, size int, cls string")
    want = brute(rows)
    assert run(df) == want
    assert run(df, star=2, block=8) == want
    assert run(df, n=5, percent=80, star=4, block=16) == brute(rows, 5, 80)
    assert g.join(df.limit(0)).count() == 0


def test_repeats_and_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (9, text.upper())], "doc_id long, text string")
    got = g.join(df).collect()
    assert len(got) == 5 and all(r.component_id == 3 for r in got if r.n_shingles and r.doc_id)
    assert [r.component_id for r in got if not r.n_shingles] == [None]


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {(x.node, x.root) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
