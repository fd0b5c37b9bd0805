"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters, digits and non-ASCII characters) enters as two vectors: one of its own, if enough training texts hold it (1 in 250, `min_docs` at least; else a shared
unknown one), and the mean of its character trigrams' vectors. Windows of WINDOW words that overlap by
WINDOW - STRIDE cover the whole text; a GRU runs over each in both directions, attention pools its
states, and a linear layer gives the window's log odds. A document's log odds pool its windows' by a soft maximum, in
training as in scoring, so labels of documents are enough. The first coordinate of a word's own vector starts as what the
training texts with and without it say (a z-score); the rest, and all after, is learnt.

Training takes at most `per_class` toxic and twice as many other labelled texts of any length (smallest hash of id first), and
of these at most BUDGET bytes in that order; of a text of more than MOST bytes, pieces of equal length spread evenly over it
with MOST bytes together. That is a documented bound; scoring takes every window of every text, however long.
The curve from log odds to probability comes from cross-fitting: each half of the training texts is scored by a network of the other.

Null or empty text: one window of no words. Documents without a label are scored only; with fewer than two classes to
learn from, every score is the share of label 1 (0.5 without labels). Null ids have no label. Repeated rows are scored alike, a score
equal to the threshold counts as toxic, an empty table gives an empty result, other columns play no part whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Spans, mix, release, spans_outside, table, text_chunks

WINDOW, STRIDE = 24, 18
MOST, BUDGET, PIECES = 1 << 18, 16 << 20, 64
WORD_DIM, CHAR_DIM, HIDDEN, CHAR_ROWS = 10, 6, 8, 4096
#: What separates words: white space and all ASCII marks, so that marks around a word do not hide it.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


@dataclass
class Network:
    words: np.ndarray  # sorted hashes that have a vector of their own; row 0 is for the rest
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    sharp: float = 2.0
    curve: tuple[float, float] = (1.0, 0.0)
    share: float | None = None


def fresh(words: np.ndarray, seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    w = {"word": r.normal(0, 0.1, (len(words) + 1, WORD_DIM)), "char": r.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)), "att_w": r.normal(0, 0.3, (2 * h, h)), "att_v": r.normal(0, 0.3, h), "out": r.normal(0, 0.3, 2 * h), "bias": np.full(1, -1.0)}
    for side in "fb":
        w |= {f"{side}_in": r.normal(0, d**-0.5, (d, 3 * h)), f"{side}_rec": r.normal(0, h**-0.5, (h, 3 * h)), f"{side}_b": np.zeros(3 * h)}
    return Network(words, {k: v.astype(np.float32) for k, v in w.items()})


def inputs(net: Network, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct words of the buffer: rows of the word table, trigram rows with their bounds; then each word's distinct index and text."""
    start, end, row = spans_outside(_BETWEEN, data, offs)
    h = Spans(data, lower=True).hash(start, end)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    at = np.searchsorted(net.words, distinct)
    own = np.where((at < len(net.words)) & (net.words[np.minimum(at, max(len(net.words) - 1, 0))] == distinct) if len(net.words) else np.zeros(len(distinct), bool), at + 1, 0)
    # trigrams of "<word>", by the bytes at, before and after each position
    s, e = start[first], end[first]
    n = e - s
    low = _UPPER[data].astype(U64)
    where = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
    begins = np.cumsum(n) - n
    mid = low[where]
    before, after = np.empty_like(mid), np.empty_like(mid)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    before[begins] = 1
    after[begins + n - 1] = 2
    gram = (mix((before << U64(16) | mid << U64(8) | after) + U64(0x5851F42D4C957F2D)) >> U64(40)).astype(np.int64) % CHAR_ROWS
    return own, gram, begins, n, inverse, row


def windows(row: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of each window (-1: none) and its text; every text has one at least, and every word is in one."""
    count = np.bincount(row, minlength=n_texts)
    many = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
    of = np.repeat(np.arange(n_texts), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    base = (np.cumsum(count) - count)[of]
    at = k[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < count[of][:, None], at + base[:, None], -1), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def vectors(w: dict, own: np.ndarray, gram: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Input vector of each distinct word; a last row of zeros stands for no word."""
    chars = np.add.reduceat(w["char"][gram], begins) / n[:, None] if len(n) else np.zeros((0, CHAR_DIM))
    return np.vstack([np.hstack([w["word"][own], chars]), np.zeros((1, WORD_DIM + CHAR_DIM))]).astype(np.float32)


def forward(w: dict, x: np.ndarray, at: np.ndarray, keep: bool = False):
    """Log odds of each window; x: vectors of distinct words, at: (windows, WINDOW) indexes into x, the last for none.

    A step without a word leaves the state as it is. keep: also returns what the backward pass needs.
    """
    b, t, h = len(at), at.shape[1], HIDDEN
    mask = (at != len(x) - 1).astype(np.float32)
    states = np.empty((t, b, 2 * h), np.float32)
    saved = []
    for d, side in enumerate("fb"):
        proj, rec = (x @ w[f"{side}_in"] + w[f"{side}_b"]).astype(np.float32), w[f"{side}_rec"]
        state = np.zeros((b, h), np.float32)
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            a = proj[at[:, i]]
            r = state @ rec
            zr = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            c = np.tanh(a[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
            gate = zr[:, :h] * mask[:, i : i + 1]
            new = state + gate * (c - state)
            if keep:
                saved.append((side, i, state, zr, c, r[:, 2 * h :], gate))
            state = new
            states[i, :, d * h : (d + 1) * h] = state
    u = np.tanh(states @ w["att_w"])
    e = u @ w["att_v"] + (mask.T - 1) * 30
    e -= e.max(0)
    p = np.exp(e)
    p /= p.sum(0)
    pooled = np.einsum("tb,tbh->bh", p, states)
    logit = pooled @ w["out"] + w["bias"][0]
    return (logit, (states, saved, u, p, pooled, mask)) if keep else logit


def backward(w: dict, x: np.ndarray, at: np.ndarray, cache, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of x."""
    states, saved, u, p, pooled, mask = cache
    h, g = HIDDEN, {}
    g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pool = d_logit[:, None] * w["out"]
    d_p = np.einsum("bh,tbh->tb", d_pool, states)
    d_e = p * (d_p - (p * d_p).sum(0))
    g["att_v"] = np.einsum("tb,tbk->k", d_e, u)
    d_u = d_e[:, :, None] * w["att_v"] * (1 - u**2)
    g["att_w"] = np.einsum("tbh,tbk->hk", states, d_u)
    d_states = p[:, :, None] * d_pool + d_u @ w["att_w"].T
    d_x = np.zeros_like(x)
    for d, side in enumerate("fb"):
        rec = w[f"{side}_rec"]
        d_proj, d_rec, carry, steps = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(rec), np.zeros((len(at), h), np.float32), []
        for s, i, state, zr, c, rc, gate in reversed(saved):
            if s != side:
                continue
            dn = d_states[i, :, d * h : (d + 1) * h] + carry
            z, r = zr[:, :h], zr[:, h:]
            d_c = dn * gate * (1 - c**2)
            d_z = dn * (c - state) * mask[:, i : i + 1] * z * (1 - z)
            d_r = d_c * rc * r * (1 - r)
            d_lin = np.hstack([d_z, d_r, d_c * r])
            d_rec += state.T @ d_lin
            carry = dn * (1 - gate) + d_lin @ rec.T
            steps.append((at[:, i], np.hstack([d_z, d_r, d_c])))
        word = np.concatenate([s[0] for s in steps])
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.diff(word[order], prepend=-1))
        d_proj[word[order][first]] = np.add.reduceat(np.concatenate([s[1] for s in steps])[order], first)
        g[f"{side}_rec"], g[f"{side}_in"], g[f"{side}_b"] = d_rec, x.T @ d_proj, d_proj.sum(0)
        d_x += d_proj @ w[f"{side}_in"].T
    return g, d_x


def pool(logit: np.ndarray, of: np.ndarray, n_texts: int, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's windows (log of the summed exponentials, so that many windows weigh more), and each window's share in it."""
    top = np.full(n_texts, -np.inf, np.float32)
    np.maximum.at(top, of, logit)
    e = np.exp(sharp * (logit - top[of]))
    total = np.bincount(of, e, n_texts)
    return top + np.log(np.maximum(total, 1e-30)) / sharp, e / total[of]


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows that go to each of n places."""
    return np.column_stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])]).astype(np.float32)


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(x or "").encode() for x in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offs[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offs


def train(texts: list[str], labels: list[int], min_docs: int = 4, epochs: int = 6, least_steps: int = 150, per_batch: int = 48, most_windows: int = 6000, rate: float = 0.02, decay: float = 0.02, drop: float = 0.1, seed: int = 3) -> Network:
    """Adam on the documents' log loss, classes weighted alike. A batch has per_batch texts, fewer if they have many windows.

    Weights but the first coordinate of words decay; words lose their own vector at random, so that none is learnt alone.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    size = []
    for x, label in zip(texts, labels, strict=True):
        data, offs = _buffer([x])
        start, end, _ = spans_outside(_BETWEEN, data, offs)
        seen[label].update(np.unique(Spans(data, lower=True).hash(start, end)).tolist())
        size.append(1 + len(start) // STRIDE)
    often = max(min_docs, len(texts) // 250)
    y = np.array(labels, np.float32)
    net = fresh(np.array(sorted(h for h in seen[0].keys() | seen[1].keys() if seen[0][h] + seen[1][h] >= often), U64), seed)
    w, size = net.weights, np.array(size)
    n = [np.array([c[h] for h in net.words.tolist()], float) for c in seen]
    of = [float((y == k).sum()) for k in (0, 1)]
    odds = [np.log((n[k] + 0.5) / (of[k] - n[k] + 0.5)) for k in (0, 1)]
    w["word"][1:, 0] = np.clip((odds[1] - odds[0]) / np.sqrt(1 / (n[0] + 0.5) + 1 / (n[1] + 0.5)) / 3, -2, 2)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    m, v, step, rng = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0, np.random.default_rng(seed)
    epochs = max(epochs, -(-least_steps // max(1, -(-len(texts) // per_batch))))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        batch = np.maximum(np.cumsum(size[order]) // most_windows, 0) * len(order) + np.arange(len(order)) // per_batch
        for pick in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            own, gram, begins, n_grams, inverse, row = inputs(net, *_buffer([texts[i] for i in pick]))
            own = np.where(rng.random(len(own)) < drop, 0, own)
            at, part_of = windows(row, len(pick))
            x = vectors(w, own, gram, begins, n_grams)
            at = np.where(at < 0, len(x) - 1, np.append(inverse, len(x) - 1)[at])
            logit, cache = forward(w, x, at, keep=True)
            doc, part = pool(logit, part_of, len(pick), net.sharp)
            d_doc = ((_sigmoid(doc) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g, d_x = backward(w, x, at, cache, (d_doc[part_of] * part).astype(np.float32))
            g["word"] = _sums(own, d_x[:-1, :WORD_DIM], len(w["word"]))
            g["char"] = _sums(gram, np.repeat(d_x[:-1, WORD_DIM:] / n_grams[:, None], n_grams, axis=0), CHAR_ROWS)
            step += 1
            scale = rate * (1 - epoch / epochs * 0.8)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                less = scale * decay * w[k]
                if k == "word":
                    less[:, 0] = 0
                w[k] -= (less + scale * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def log_odds(net: Network, data: np.ndarray, offs: np.ndarray, per_batch: int = 4096) -> np.ndarray:
    """Pooled log odds of each text in the buffer."""
    own, gram, begins, n, inverse, row = inputs(net, data, offs)
    at, of = windows(row, len(offs) - 1)
    x = vectors(net.weights, own, gram, begins, n)
    at = np.where(at < 0, len(x) - 1, np.append(inverse, len(x) - 1)[at])
    logit = np.concatenate([forward(net.weights, x, at[lo : lo + per_batch]) for lo in range(0, len(at), per_batch)])
    return pool(logit, of, len(offs) - 1, net.sharp)[0]


def curve(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and intercept of a weighted logistic fit."""
    w, z = np.array([1.0, 0.0]), np.column_stack([odds, np.ones(len(odds))]).astype(float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (weight * (p - y)) + 0.1 * (w - [1, 0])
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def spread(text: bytes, most: int = MOST, pieces: int = PIECES) -> bytes:
    """The text, or pieces of it with `most` bytes together, evenly spread, where it has more."""
    if len(text) <= most:
        return text
    each = most // pieces
    return b" ".join(text[a : a + each] for a in np.linspace(0, len(text) - each, pieces).astype(int))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """labels: doc_id, label (0 or 1). At most 3 * per_class texts and BUDGET bytes reach the driver."""
    known = labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Network(np.zeros(0, U64), share=float(counts.get(1, 0) / sum(counts.values())) if counts else 0.5)
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    # twice as many as needed: a label's document may be gone
    parts = [hashed.filter(F.col("label") == k).orderBy("h", "doc_id").limit(2 * per_class * (2 - k)) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 6 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([spread(x) for x in b.column(3).to_pylist()], pa.binary())], names=["doc_id", "h", "label", "text"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = table(texts.join(chosen, "doc_id").select("doc_id", "h", "label", "text").mapInArrow(cut, f"doc_id {kind}, h long, label int, text binary"), "toxicity-texts")
    rows = []
    for k in (0, 1):
        left = BUDGET * (2 - k) // 3
        for r in found.filter(F.col("label") == k).orderBy("h", "doc_id", "text").limit(per_class * (2 - k)).toLocalIterator():
            left -= len(r["text"])
            if left < 0:
                break
            rows.append((bytes(r["text"]).decode("utf-8", "replace"), k))
    release(found)
    text, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    if min((y == k).sum() for k in (0, 1)) < 2:
        return Network(np.zeros(0, U64), share=float(counts[1] / sum(counts.values())))
    half = np.zeros(len(y), int)
    for k in (0, 1):
        half[y == k] = np.arange((y == k).sum()) % 2
    odds = np.zeros(len(y))
    for side in (0, 1):
        part = train([t for t, h in zip(text, half, strict=True) if h == side], y[half == side].tolist())
        odds[half != side] = np.concatenate([log_odds(part, *_buffer([t])) for t, h in zip(text, half, strict=True) if h != side])
    total = sum(counts.values())
    net = train(text, y.tolist())
    net.curve = curve(odds, y, np.where(y == 1, counts[1] / total / (y == 1).mean(), counts[0] / total / (y == 0).mean()))
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """doc_id, score, predicted of every document."""
    net = net or fit(docs, labels, id_col=id_col, text_col=text_col)

    def each(batches):
        for rows, data, offs in text_chunks(batches):
            s = scores(net, data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, score double, predicted int")


def scores(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Probability that each text of the buffer is toxic."""
    if net.share is not None:
        return np.full(len(offs) - 1, net.share)
    a, b = net.curve
    return 1 / (1 + np.exp(-np.clip(a * log_odds(net, data, offs).astype(float) + b, -35, 35)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score stays under the threshold; columns stay."""
    net = fit(docs, labels, id_col=id_col, text_col=text_col)

    def each(batches):
        for rows, data, offs in text_chunks(batches, text_col):
            yield rows.filter(pa.array(scores(net, data, offs) < threshold))

    return docs.mapInArrow(each, docs.schema)
