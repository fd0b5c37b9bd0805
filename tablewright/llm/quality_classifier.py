"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a whole text (shares of kinds of bytes, word and line shapes, repetition) are squashed by
logarithms and written once as a table. Class means and covariances come from count, sum and outer-product sums of
all labelled training rows, merged in two steps. Covariances are shrunk towards the pooled one and towards
a multiple of the identity; their Cholesky factors are computed once, kept in the model, and reused for
every batch. The raw score is the difference of the classes' Mahalanobis log densities;
a logistic curve fitted to its histogram on training rows turns it into a probability.

Null or empty text: all counts zero, scored like any other. Documents without a label are scored, not learnt from;
labels without a document play no part, and null ids have no label. With fewer than two classes to learn from, the score is the share
of label 1 (0.5 with no label at all). Repeated rows count as often as they occur. A score equal to the threshold counts as good.
Texts of any length are read whole. An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, table, text_chunks, word_hashes, word_spans

_KIND = np.zeros(256, np.int64)  # 0: any other
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[192:] = 1, 2, 3, 4
for _k, _chars in ((5, b"#*$%&|<>"), (6, b"!?"), (7, b"."), (8, b",;:"), (9, b" \t\r\x0b\x0c"), (10, b"\n"), (11, b"\"'()[]{}-_/\\@=+^~`")):
    _KIND[list(_chars)] = _k
_KIND[128:192] = 12
N_KINDS = 13
NAMES = ("bytes", "words", "upper", "lower", "digit", "beyond_ascii", "symbol", "mark", "stop", "comma", "other", "blank", "word_size", "word_spread", "distinct", "again", "top_word", "trios", "lines", "line_size", "same_lines")


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and the count of its most frequent one."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, r[new], np.diff(new, append=len(r)))
    return np.bincount(r[new], minlength=n).astype(float), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text, in the order of NAMES."""
    n, sizes = len(offs) - 1, np.diff(offs)
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * N_KINDS + _KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    chars = np.maximum(sizes - kinds[:, 12], 1)
    start, end, row = word_spans(data, offs)
    h, _ = word_hashes(data, offs)
    words = np.bincount(row, minlength=n).astype(float)
    some, long = np.maximum(words, 1), (end - start).astype(float)
    mean = np.bincount(row, long, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, long**2, n) / some - mean**2, 0))
    distinct, top = _distinct(row, h, n)
    again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) else np.zeros(n)
    inside = row[2:] == row[:-2]
    trios, _ = _distinct(row[2:][inside], (h[2:] + h[1:-1] * np.uint64(3) + h[:-2] * np.uint64(7))[inside], n)
    # lines with anything on them
    cut = np.flatnonzero(data == 10)
    bounds = np.unique(np.r_[offs, cut, cut + 1])
    a, b = bounds[:-1], bounds[1:]
    a, b = a[data[a] != 10], b[data[a] != 10]
    of = np.searchsorted(offs, a, "right") - 1
    lines = np.bincount(of, minlength=n).astype(float)
    kept, _ = _distinct(of, Spans(data).hash(a, b), n) if len(a) else (np.zeros(n), None)
    share = lambda x, y: np.log(0.003 + x / np.maximum(y, 1))
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), *(share(kinds[:, k], chars) for k in (1, 2, 3, 4, 5, 6, 7, 8, 11, 9)),
        np.log1p(mean), np.log1p(spread), share(distinct, words), share(again, words), share(top, words),
        share(np.maximum(words - 2, 0) - trios, words - 2), np.log1p(lines), np.log1p(sizes / np.maximum(lines, 1)), share(lines - kept, lines),
    ])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics, as little-endian doubles."""

    def each(batches):
        for rows, data, offs in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.tobytes() for x in statistics(data, offs)], pa.binary())], names=["doc_id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, stats binary")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray  # of class 0 and 1, scaled
    inverses: np.ndarray  # inverse Cholesky factors of the shrunk covariances
    logs: np.ndarray  # half log determinants
    curve: tuple[float, float] = (1.0, 0.0)
    share: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        far = [((z - c) @ i.T) for c, i in zip(self.centres, self.inverses, strict=True)]
        return (0.5 * (far[0] ** 2).sum(1) + self.logs[0]) - (0.5 * (far[1] ** 2).sum(1) + self.logs[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * squash(self.log_odds(x)) + b, -35, 35)))


def squash(odds: np.ndarray) -> np.ndarray:
    """Keeps the order of log odds, and the far ones within reach of a logistic fit."""
    return np.sign(odds) * np.log1p(np.abs(odds))


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def moments(stats: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products for each label; stats has (stats, label)."""

    def partial(batches):
        sums: dict[int, list] = {}
        for b in batches:
            x, y = _unpack(b.column(0)), b.column(1).to_numpy()
            for k in (0, 1):
                v = x[y == k]
                s = sums.setdefault(k, [0.0, 0.0, 0.0])
                sums[k] = [s[0] + len(v), s[1] + v.sum(0), s[2] + v.T @ v]
        packed = [(k, np.r_[s[0], s[1], s[2].ravel()].tobytes()) for k, s in sums.items() if s[0]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([v for _, v in packed], pa.binary())], names=["label", "sums"])

    def merge(key, group):
        total = np.sum([np.frombuffer(x, "<f8") for x in group.column("sums").to_pylist()], axis=0)
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = stats.select("stats", F.col("label").cast("int")).mapInArrow(partial, "label int, sums binary").withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(32)))
    rows = parts.groupBy("label", "_g").applyInArrow(merge, "label int, sums binary").collect()  # at most 64 rows
    out: dict = {}
    for r in rows:
        v = np.frombuffer(bytes(r["sums"]), "<f8")
        out[r["label"]] = out.get(r["label"], 0) + v
    p = len(NAMES)
    return {k: (v[0], v[1 : p + 1], v[p + 1 :].reshape(p, p)) for k, v in out.items()}


def discriminant(sums: dict, to_pooled: float = 0.2, to_identity: float = 0.05) -> Model:
    """Shrunk class Gaussians from the moments of both classes."""
    n = sum(s[0] for s in sums.values())
    mean = sum(s[1] for s in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - mean**2, 1e-6))
    covs, centres = {}, {}
    for k, (m, s, q) in sums.items():
        centres[k] = (s / m - mean) / scale
        covs[k] = (q / m - np.outer(s / m, s / m)) / np.outer(scale, scale)
    pooled = sum(sums[k][0] * covs[k] for k in sums) / n
    inverses, logs = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covs[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * np.eye(len(c)) * np.trace(c) / len(c)
        factor = np.linalg.cholesky(c)
        inverses.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    return Model(mean, scale, np.array([centres[0], centres[1]]), np.array(inverses), np.array(logs))


def logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps over binned values; the slope stays positive."""
    w = np.array([1.0, np.log((pos.sum() + 1) / (neg.sum() + 1))])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ ((pos + neg) * p - pos) + 1e-2 * (w - [1, 0])
        hess = (z * ((pos + neg) * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: doc_id, stats. labels: doc_id, label (0 or 1; anything else is left out)."""
    known = stats.join(labels.filter("label in (0, 1)").select("doc_id", "label"), "doc_id").select("stats", F.col("label").cast("int").alias("label"))
    sums = moments(known)
    if len(sums) < 2 or min(s[0] for s in sums.values()) < 2:
        n, ones = sum(s[0] for s in sums.values()), sums[1][0] if 1 in sums else 0
        p = len(NAMES)
        return Model(np.zeros(p), np.ones(p), np.zeros((2, p)), np.array([np.eye(p)] * 2), np.zeros(2), share=float(ones / n) if n else 0.5)
    model = discriminant(sums)

    def bins(batches):
        for b in batches:
            v = squash(model.log_odds(_unpack(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(v * 20), -300, 300).astype(np.int32)), b.column(1)], names=["bin", "label"])

    counts = known.mapInArrow(bins, "bin int, label int").groupBy("bin", "label").count().collect()  # at most 1202 rows
    at = sorted({r["bin"] for r in counts})
    pos, neg = ({r["bin"]: r["count"] for r in counts if r["label"] == k} for k in (1, 0))
    model.curve = logistic(np.array(at) / 20, np.array([pos.get(b, 0) for b in at], float), np.array([neg.get(b, 0) for b in at], float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) to statistics and drops them; other columns stay."""
    names = [n for n in stats.columns if n != "stats"]

    def each(batches):
        for b in batches:
            x = model.score(_unpack(b.column("stats"))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(x, pa.float64())], names=[*names, "score"])

    fields = ", ".join(f"{n} {stats.schema[n].dataType.simpleString()}" for n in names)
    return stats.mapInArrow(each, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every document, learnt from labels (doc_id, label)."""
    stats = table(measure(docs, id_col, text_col), "quality-stats")
    return score(stats, fit(stats, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold; columns stay, and no text is shuffled."""
    stats = table(measure(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels)

    def each(batches):
        for rows, data, offs in text_chunks(batches, text_col):
            yield rows.filter(pa.array(model.score(statistics(data, offs)) >= threshold))

    return docs.mapInArrow(each, docs.schema)
