"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good, bad or abstains. The votes of all documents are counted by pattern (at most
3**rules rows, whatever the corpus), expectation-maximisation over those counts estimates how often
each rule votes either way on good and on bad documents, and a document is kept when its posterior
probability of being good reaches the threshold. Two base checks reject a document outright.

Null text: no words. Empty text and tables: rows with zeros, an empty result. Repeated rows are
counted and returned as often as they occur. Null ids are rows like others. A posterior equal to the threshold keeps a document.
Texts of any length are read whole. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = ("v_length", "v_symbols", "v_dup_lines", "v_repeats", "v_capitals", "v_word_size", "v_marks")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: Catalyst does not share what stands inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; n log n in the words."""
    n = F.size(words)

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def sorted_windows(order: Column) -> Column:
        m, no = F.size(order), F.array(F.lit(False))
        same = F.zip_with(F.slice(order, 1, m - 1), F.slice(order, 2, m - 1), lambda a, b: a["h"] == b["h"])
        at = _let(same, lambda s: F.sort_array(F.array_compact(F.zip_with(F.zip_with(F.concat(no, s), F.concat(s, no), lambda a, b: a | b), order, lambda f, x: F.when(f, x["i"])))))
        return _let(at, covered)

    def hashed(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(order, sorted_windows))

    trio = F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c"))
    return F.when(n < 4, 0).otherwise(_let(F.transform(trio, lambda x: F.xxhash64(x["a"], x["b"], x["c"])), hashed)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules look at, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _let(
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]"), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")),
    )
    lines = _let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    # one struct, so that no later projection computes a part of it again
    every = _let(
        F.struct(words.alias("w"), lines.alias("l"), count("[#*$%&|<>]").alias("n_symbols"), count("\\p{Lu}").alias("n_upper"), count("!!|\\?\\?|\\.\\.\\.").alias("n_marks")),
        lambda x: F.struct(*(x["w"][c].alias(c) for c in ("n_words", "word_chars")), x["n_symbols"].alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"), x["l"]["n_lines"].alias("n_lines"), x["n_upper"].alias("n_upper"), x["n_marks"].alias("n_marks")),
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(every)))


def votes(m: DataFrame) -> DataFrame:
    """1 good, -1 bad, 0 abstain, for each of RULES."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(value: Column, good: float, bad: float) -> Column:
        """Good up to `good`, bad from `bad` on."""
        return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)

    size = F.col("word_chars") / words
    return m.withColumns({
        "v_length": F.when(F.col("n_words") >= 100, 1).when(F.col("n_words") < 20, -1).otherwise(0),
        "v_symbols": vote(F.col("n_symbols") / words, 0.02, 0.15),
        "v_dup_lines": F.when(F.col("n_lines") < 4, 0).otherwise(vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.1, 0.4)),
        "v_repeats": vote(F.col("n_repeat_words") / words, 0.15, 0.4),
        "v_capitals": vote(F.col("n_upper") / chars, 0.12, 0.4),
        "v_word_size": F.when(size.between(3, 10), 1).when((size < 2) | (size > 16), -1).otherwise(0),
        "v_marks": vote(F.col("n_marks") / words, 0.02, 0.2),
    })


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.85) -> tuple[float, list[dict], list[dict]]:
    """Expectation-maximisation over (votes, documents) pairs: P(good) and each rule's vote rates on good and bad.

    Rates carry one pseudo-document per vote, scaled by the start's belief that rules vote right,
    so a rule that never votes keeps that belief and the two classes cannot swap.
    """
    n_rules = len(counts[0][0]) if counts else len(RULES)
    start = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.2, 0: 0.3, -1: 0.5}}
    good, bad = ([dict(start[k]) for _ in range(n_rules)] for k in (True, False))
    p = prior
    for _ in range(rounds):
        sums = {k: [{v: 10 * start[k][v] for v in (1, 0, -1)} for _ in range(n_rules)] for k in (True, False)}
        mass = {True: 10 * prior, False: 10 * (1 - prior)}
        for pattern, n in counts:
            q = posterior(pattern, p, good, bad)
            for k, w in ((True, q * n), (False, (1 - q) * n)):
                mass[k] += w
                for j, v in enumerate(pattern):
                    sums[k][j][v] += w
        new = [[{v: x / sum(s.values()) for v, x in s.items()} for s in sums[k]] for k in (True, False)]
        moved = max((abs(new[0][j][v] - good[j][v]) for j in range(n_rules) for v in (1, 0, -1)), default=0)
        (good, bad), p = new, mass[True] / (mass[True] + mass[False])
        if moved < 1e-7:
            break
    return p, good, bad


def posterior(pattern: tuple[int, ...], p: float, good: list[dict], bad: list[dict]) -> float:
    x = math.log(p) - math.log(1 - p) + sum(math.log(g[v]) - math.log(b[v]) for v, g, b in zip(pattern, good, bad, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def apply(docs: DataFrame, threshold: float = 0.5, min_words: int = 50, max_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base check, posterior and verdict of each document."""
    voted = table(votes(measures(docs, id_col, text_col)), "rule-votes")
    pattern = sum((F.col(r) + 1) * 3**j for j, r in enumerate(RULES)).cast("int")
    counts = voted.groupBy(pattern.alias("k")).count().collect()  # at most 3**7 rows
    decode = lambda k: tuple(k // 3**j % 3 - 1 for j in range(len(RULES)))
    model = fit(sorted((decode(r["k"]), r["count"]) for r in counts))
    known = [x for r in counts for x in (F.lit(r["k"]), F.lit(posterior(decode(r["k"]), *model)))]
    prob = F.element_at(F.create_map(*known), pattern) if known else F.lit(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), prob.cast("double").alias("p_good")).select(
        "*", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept")
    )
