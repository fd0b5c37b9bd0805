import random

import numpy as np

from tablewright.llm import licenses as x


def test_finds_spans(spark):
    r = random.Random(1)
    fill = lambda n: " ".join(r.choice(["tree", "river", "stone", "license", "the", "under"]) for _ in range(n))
    gpl = x.TEMPLATES["GPL-header"]
    rows = [(1, f"{fill(50)}\nReleased under the MIT License.\n{fill(2000)}"), (2, fill(300)), (3, None), (4, ""), (5, gpl.replace("modify", "change").replace("software", "open software").upper()), (6, "Licensed under CC BY-NC 4.0. and again: licensed under CC BY-NC 4.0"), (7, fill(30000) + " " + gpl), (None, "Released under the MIT License"), (1, "Released under the MIT License")]
    got = x.scan(spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, license string")).collect()
    names = sorted(((g.doc_id, g.license) for g in got), key=str)
    assert names == sorted([(1, "MIT"), (1, "MIT"), (5, "GPL-header"), (6, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0"), (7, "GPL-header"), (None, "MIT")], key=str)
    text = dict(rows[:7])
    for g in got:
        assert 0.7 <= g.coverage <= 1
        if g.doc_id == 7:
            assert text[7][g.start_char : g.end_char] == gpl.rstrip(".")
    assert x.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_matches_full_table():
    """A wide band is the whole local alignment; a narrow one on the right diagonal finds as much."""
    r = random.Random(4)
    for _ in range(100):
        a = [r.choice("abcdefgh") for _ in range(12)]
        b = [r.choice("xyz") for _ in range(5)] + [w for w in a if r.random() > 0.1] + [r.choice("xyz") for _ in range(5)]
        assert x.align(a, b, 5, 4)[0] <= x.align(a, b, 0, 40)[0]
        if len(a) + 10 - len(b) <= 4:  # so few gaps stay inside the band
            assert x.align(a, b, 5, 4)[0] == x.align(a, b, 0, 40)[0] > 0


def test_table_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.license) for r in x.scan(docs).filter("coverage = 1").collect()}
    want = {(d.doc_id, k) for d in docs.collect() for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0") if x.TEMPLATES[k] in d.text}
    assert want <= got


def test_a_shared_run_shares_a_fingerprint():
    r = np.random.default_rng(7)
    for _ in range(200):
        run = r.integers(1, 50, x.GRAM + x.WINDOW - 1)
        a, b = (np.r_[r.integers(1, 50, r.integers(0, 9)), run, r.integers(1, 50, r.integers(0, 9))].astype(np.uint64) for _ in range(2))
        assert set(x.winnow(a)[0].tolist()) & set(x.winnow(b)[0].tolist())


def test_finds_are_all_and_only_those_of_the_full_table():
    """Against a local alignment of each template with the whole text, without an index."""
    r = random.Random(11)
    templates = {f"t{i}": " ".join(r.sample([f"w{j}" for j in range(40)], 12)) for i in range(4)}
    index = x.Index(templates)
    for _ in range(150):
        words = [f"z{r.randrange(9)}" for _ in range(r.randrange(20))]
        for name in r.sample(sorted(templates), r.randrange(3)):
            w = templates[name].split()
            a = r.randrange(3)
            words += [f"z{r.randrange(9)}" if r.random() < 0.08 else v for v in w[a:]] + [f"z{r.randrange(9)}" for _ in range(r.randrange(1, 20))]
        got = {n: c for n, c, *_ in index.scan(" ".join(words), x.BAND, 0.7)}
        want = {n: m / 12 for n, t in templates.items() if (m := x.align(t.split(), words, 0, len(words) + 12)[0]) / 12 >= 0.7}
        assert got == want


def test_a_whole_licence_with_edits_is_one_find():
    text = x.TEMPLATES["MIT-text"].replace("sublicense", "sub license").replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
    found = [f for f in x.Index(x.TEMPLATES).scan("head words\n\n" + text + "\n\ntail words", x.BAND, 0.7) if f[0] == "MIT-text"]
    assert len(found) == 1 and found[0][1] > 0.95
    assert (found[0][3], found[0][4]) == (12, 12 + len(text) - 1)


def test_equal_rows_are_found_alike(spark):
    rows = x.scan(spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License.")], "doc_id long, text string")).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
