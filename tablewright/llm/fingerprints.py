"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph becomes a wide vector, a document the sum of its paragraphs' vectors, lane by lane modulo
powers of two. So the order of paragraphs plays no part, and a paragraph is inserted or deleted by
adding or subtracting its vector alone (`insert`, `delete`). Two kinds of lanes:

* 4 equality lanes modulo 2**64, random values drawn by the hash of the whole paragraph;
* LANES likeness lanes modulo 2**16: each 8-byte window of the paragraph (its whole bytes if shorter)
  adds +1 or -1 to one lane. A difference of two fingerprints is the vector of what the texts do not share, and its squared
  length estimates how much that is, so likeness = 1 - |a-b|^2 / (|a|^2 + |b|^2), held to 0..1.

Null text: empty, whose fingerprint is all zeros (likeness 1 to another empty one, 0 to anything else). Repeated rows have equal
fingerprints and follow each other; rows of one id follow each other in the order of their texts, null ids come last. Texts of any length
are read whole. An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Spans, input_slices, mix, text_chunks

LANES, WINDOW, EQUAL = 256, 8, 4
_SALT = mix(np.arange(1, EQUAL + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))


def vectors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equality lanes (uint64) and likeness lanes (uint16) of each text in the buffer."""
    n = len(offs) - 1
    equal, like = np.zeros((n, EQUAL), U64), np.zeros((n, LANES), np.uint16)
    if not len(data):
        return equal, like
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    line = data == 10
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= line[:-1]
    after[:-1] |= line[1:]
    start, end = np.flatnonzero(before & ~line), np.flatnonzero(after & ~line) + 1
    if not len(start):
        return equal, like
    row, spans = np.searchsorted(offs, start, "right") - 1, Spans(data)
    h = spans.hash(start, end)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    for k in range(EQUAL):
        equal[row[at], k] = np.add.reduceat(mix(h ^ _SALT[k]), at)
    # windows: all starts of a paragraph that leave WINDOW bytes, or its start where it is shorter
    short = end - start < WINDOW
    many = np.where(short, 1, end - start - WINDOW + 1)
    w = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
    to = np.minimum(w + WINDOW, np.repeat(end, many))
    g = spans.hash(w, to)
    of = np.repeat(row, many) * LANES + (g >> U64(56)).astype(np.int64)
    size = n * LANES
    total = 2 * np.bincount(of[(g & U64(1)) == 1], minlength=size) - np.bincount(of, minlength=size)
    return equal, total.reshape(n, LANES).astype(np.int64).astype(np.uint16)


def encode(equal: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(equal.astype("<u8").tobytes() + like.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EQUAL], "<u8").astype(U64), np.frombuffer(raw[8 * EQUAL :], "<u2").astype(np.uint16)


def of_text(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    equal, like = vectors(data, np.array([0, len(data)]))
    return encode(equal[0], like[0])


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the text with one more paragraph."""
    (a, b), (c, d) = decode(fingerprint), decode(of_text(paragraph))
    return encode(a + c, b + d)


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the text with one occurrence of the paragraph less."""
    (a, b), (c, d) = decode(fingerprint), decode(of_text(paragraph))
    return encode(a - c, b - d)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 1 for equal lanes."""
    signed = lambda x: x.astype(np.int16).astype(np.float64)
    apart = (signed(a - b) ** 2).sum(axis=-1)
    size = (signed(a) ** 2).sum(axis=-1) + (signed(b) ** 2).sum(axis=-1)
    return np.where(apart == 0, 1.0, np.clip(1 - apart / np.maximum(size, 1), 0, 1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""

    def each(batches):
        for rows, data, offs in text_chunks(batches):
            equal, like = vectors(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encode(e, x) for e, x in zip(equal, like, strict=True)], pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, fingerprint string")


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def _pairs(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows of the edit query: each text, and it with its end replaced by the next one's start."""
    n = [len(x) for x in texts]
    edited = [(x[: k - k // 3] + y[: k // 3]).encode() for x, y, k in zip(texts, following, n, strict=True)]
    own = [x.encode() for x in texts]
    equal, like = vectors(*_buffer(own))
    e_equal, e_like = vectors(*_buffer(edited))
    _, next_like = vectors(*_buffer([x.encode() for x in following]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array([encode(*x) for x in zip(equal, like, strict=True)]), pa.array([encode(*x) for x in zip(e_equal, e_like, strict=True)]),
            pa.array(likeness(like, e_like)), pa.array(likeness(like, next_like)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_next(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Compares each text with the next one by descending id, and with itself after its last third became the next one's start.

    Ids are cut into ranges at their percentiles; a range is read in order by one task, and the first
    document of each range goes to the range before it too (rows that share its id with it; null ids, all of one range, go twice
    where that range holds nothing else). All rows of one id, and all null ids, are read by one task.
    Texts are shuffled once. Rows that share an id follow each other in the order of their texts; null ids come last.
    """
    n = slices or input_slices(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10000).alias("q")).first()["q"] if shares else None
    cuts = np.array(sorted({int(x) for x in found or []}), np.int64)  # slices - 1 values at most

    def place(batches):
        """Adds each row's range, from the largest ids down; null ids go to the last one, which also holds the smallest."""
        for x in batches:
            ids = x.column(0)
            b = len(cuts) - np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), ids, *x.columns[1:]], names=["b", "doc_id", *x.schema.names[1:]])

    tops = {r["b"]: r["top"] for r in rows.select("doc_id").mapInArrow(place, "b int, doc_id long").groupBy("b").agg(F.max("doc_id").alias("top")).collect()}  # one row for each range
    order = sorted(tops)
    firsts = np.array(sorted((tops[b], order[i - 1]) for i, b in enumerate(order) if tops[b] is not None) or np.zeros((0, 2)), np.int64)
    null_to = next((order[i - 1] for i, b in enumerate(order) if tops[b] is None), None)

    def copy_firsts(batches):
        """A range's first document goes to the range before it as well (the very first to the last), behind that one's own rows."""
        for x in place(batches):
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.zeros(len(x), np.int8)), *x.columns[1:]], names=["b", "tail", "doc_id", "text"])
            ids = x.column(1).fill_null(np.iinfo(np.int64).min).to_numpy()
            at = np.minimum(np.searchsorted(firsts[:, 0], ids), max(len(firsts) - 1, 0))
            null = x.column(1).is_null().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((firsts[at, 0] == ids) & ~null) if len(firsts) else np.zeros(0, np.int64)
            to = firsts[at[hit], 1] if len(firsts) else hit
            if null_to is not None and null.any():
                hit, to = np.append(hit, np.flatnonzero(null)), np.append(to, np.full(null.sum(), null_to))
            if len(hit):
                y = x.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(hit), np.int8)), *y.columns[1:]], names=["b", "tail", "doc_id", "text"])

    placed = rows.mapInArrow(copy_firsts, "b int, tail byte, doc_id long, text string")

    def each(batches):
        from itertools import chain

        stream = chain.from_iterable(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True) for x in batches)
        held, ids, texts, following, size = None, [], [], [], 0
        for b, tail, doc, text in stream:
            if held is not None and held[0] == b:
                ids.append(held[2]), texts.append(held[3]), following.append(text)
                size += len(held[3])
                if size > 1 << 20:
                    yield _pairs(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
            held = None if tail else (b, tail, doc, text)
        if ids:
            yield _pairs(ids, texts, following)

    return (
        placed.repartition(n, "b").sortWithinPartitions("b", "tail", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
