"""Suffix-array dedup: removes bytes covered by a `span`-byte string that also starts in a document with a smaller id.

Prefix doubling ranks suffixes by their first 1, 2, 4, ... bytes: the rank at twice the length is the pair of ranks
at i and i + length, sorted and renamed, until it is unique or the length passes the threshold. Here:

* A rank is named by a 64-bit hash of its pair, so equal strings get equal names without a sort. The
  doublings up to NAME bytes therefore run where the text lies.
* Suffixes are sampled: of every `span` consecutive bytes, the start with the least name (the leftmost of equals) is an
  anchor. The choice depends on those bytes alone, so two equal strings of that length have the same anchor at the
  same place, and no match is lost.
* Spark deals the anchors out and sorts them by name. A name of one document only is unique: it goes. The others are ranked
  again by a longer string, all the bytes whose windows chose the anchor; where the rank is that of a smaller
  document, all those windows match at once.
* Of the documents that are first to hold such a string, those whose anchor others share are ranked once more, window by window, by
  names that reach the threshold exactly. A window around an anchor holds half of what the threshold asks beyond the name on one
  side of it at least, so only anchors that agree with another document's so far on one side can match.

A third of all rows in one group of copies stays cheap: of equal strings within a chunk of texts only the one of the smallest id is
sent, and none where the task has lately sent it for a smaller id. Null text: empty. A null id is greater than all others (2**63 - 1
counts as one). Texts of any length are read whole; where they are cut depends on no other text. Rows that share an id never match each other; each
keeps its own bytes. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import filters
from .common import _BYTES, U64, Spans, buckets_for, free_exchanges, give_back, mix, table, text_chunks

NAME, CHUNK = 24, 1 << 19
PER_BUCKET = 64 << 20  # bytes of text whose anchors meet in a bucket
_STEP = mix(np.arange(1, 9, dtype=U64)) | U64(1)


def names(data: np.ndarray, size: int = NAME) -> np.ndarray:
    """Names of the `size`-byte strings at every position but the last ones, by doubling; the last step overlaps less than it could."""
    more = size - (1 << (size.bit_length() - 1))
    width = 1 << (more - 1).bit_length() if more else 0  # of the name that covers the rest
    h, n, part = _BYTES[data], 1, None
    while True:
        if n == width:
            part = h
        if 2 * n > size:
            break
        h = h[: max(len(h) - n, 0)] * _STEP[n.bit_length()] + h[n:]
        n *= 2
    if more:
        last = max(len(data) - size + 1, 0)
        h = h[:last] * _STEP[7] + part[size - width :][:last]
    return mix(h)


def anchors(data: np.ndarray, offs: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last start of the windows that chose it, its text and its name, in order."""
    name = names(data)
    wide = span - NAME + 1
    n = len(data) - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    bits = U64(max(1, int(len(data)).bit_length()))
    key = (name >> bits << bits) | np.arange(len(name), dtype=U64)
    least, have = key, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(key) - wide + 1], least[wide - have :][: len(key) - wide + 1])
    at = (least[:n] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    ok = np.ones(n, bool)
    for o in offs[1:-1]:  # windows that cross into the next text
        ok[max(0, o - span + 1) : max(0, min(o, n))] = False
    start = np.flatnonzero(ok)
    at = at[start]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    a, lo, hi = at[new], start[new], start[np.append(new[1:], len(at)) - 1] if len(at) else at
    return a, lo, hi, np.searchsorted(offs, a, "right") - 1, name[a]


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64)


_BLOB = "bucket int, n int, hashes binary, places binary, ids binary"
_HIT = "k long, t int, lo int, hi int"


CACHE = 1 << 16  # strings that a task remembers to have sent


def _keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return rows.column(0).to_numpy(), rows.column(1).to_numpy()


def _by_bucket(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _blobs(buckets: int, bucket: np.ndarray, hashes: list[np.ndarray], row: np.ndarray, lo: np.ndarray, more: list[np.ndarray], k: np.ndarray, t: np.ndarray):
    """One packed row for each bucket: hashes, text, place and byte-wide columns of its entries."""
    out: list[list] = [[], [], [], [], []]
    for b, i in _by_bucket(bucket, buckets):
        used, idx = np.unique(row[i], return_inverse=True)
        for c, v in zip(out, (b, len(i), b"".join(_six(h[i]) for h in hashes), _squeeze(np.diff(idx, prepend=0).astype("<i4"), np.diff(lo[i], prepend=0).astype("<i4"), *(m[i].astype(np.uint8) for m in more)), _squeeze(np.diff(k[used], prepend=0).astype("<i8"), t[used].astype("<i4"))), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["bucket", "n", "hashes", "places", "ids"])


def _unpack(group: pa.Table, n_hashes: int, n_more: int) -> list[np.ndarray]:
    """Hashes, k, t, lo and byte columns of all blobs of a bucket."""
    parts: list[list] = [[] for _ in range(n_hashes + 3 + n_more)]
    expand = zstandard.ZstdDecompressor().decompress
    for n, hashes, places, ids in zip(*(group.column(c).to_pylist() for c in ("n", "hashes", "places", "ids")), strict=True):
        raw, who = expand(places), expand(ids)
        idx, lo = np.cumsum(np.frombuffer(raw[: 4 * n], "<i4")), np.cumsum(np.frombuffer(raw[4 * n : 8 * n], "<i4"))
        m = len(who) // 12
        k, t = np.cumsum(np.frombuffer(who[: 8 * m], "<i8")), np.frombuffer(who[8 * m :], "<i4")
        cols = [*(_from_six(hashes[6 * n * j : 6 * n * (j + 1)]) for j in range(n_hashes)), k[idx], t[idx], lo, *(np.frombuffer(raw[(8 + j) * n : (9 + j) * n], np.uint8) for j in range(n_more))]
        for p, c in zip(parts, cols, strict=True):
            p.append(c)
    return [np.concatenate(p) for p in parts]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, which are sorted."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _hits(k, t, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["k", "t", "lo", "hi"])


def _copies(k: np.ndarray, t: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks texts of a chunk that equal one of a smaller id in it: hash and size are the same."""
    order = np.lexsort((k, t, size))
    g = _groups(size[order], t[order])
    out = np.zeros(len(k), bool)
    out[order] = k[order] > np.repeat(k[order][g], np.diff(g, append=len(order)))
    return out


def _first_of(key: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Marks entries of a larger id than another one of the same key."""
    order = np.lexsort((k, key))
    g = _groups(key[order])
    out = np.zeros(len(k), bool)
    out[order] = k[order] > np.repeat(k[order][g], np.diff(g, append=len(order)))
    return out


def _meet(name: np.ndarray, side: np.ndarray, whole: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Marks entries whose name and side (not 0) several strings and several ids have."""
    order = np.lexsort((side, name))
    g = _groups(name[order], side[order])
    out = np.zeros(len(k), bool)
    if len(g):
        several = np.logical_and.reduce([np.minimum.reduceat(x[order], g) != np.maximum.reduceat(x[order], g) for x in (whole, k)])
        out[order] = np.repeat(several, np.diff(g, append=len(k))) & (side[order] != 0)
    return out


def _holder(name: np.ndarray, whole: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Names a string at an anchor in a document."""
    low = U64((1 << 48) - 1)
    return mix((name & low) * _STEP[1] + (whole & low) * _STEP[2] + k.astype(U64) * _STEP[3])


def duplicated(docs: DataFrame, span: int) -> list[DataFrame]:
    """Runs of window starts (k, t: the row; lo, hi: first and last start) whose `span`-byte string starts in a smaller document too.

    docs: k (id, the largest long for null), t (a hash of the text, to tell rows of one id apart), text.
    """
    if span < NAME + 1:
        raise ValueError(f"span must be {NAME + 1} at least")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets, low, far, half = buckets_for(docs, size, PER_BUCKET), U64((1 << 48) - 1), 1 if span - NAME < 256 else 4, (span - NAME + 1) // 2

    def kept_anchors(rows, data, offs):
        k, t = _keys(rows)
        copy = _copies(k, rows.column(2).to_numpy(), np.diff(offs))
        a, lo, hi, row, name = anchors(data, offs, span)
        keep = ~copy[row]
        return k, t, copy, lo[keep], hi[keep], row[keep], name[keep], a[keep]

    def sides(spans: Spans, a, lo, hi) -> list[np.ndarray]:
        """Three bytes each of the hash of an anchor's name and `half` bytes before it, or after it; 0 where no window reaches so far."""
        left = np.where(a - lo >= half, spans.hash(np.maximum(a - half, lo), a + NAME) >> U64(40) | U64(1), U64(0))
        right = np.where(hi + span - a - NAME >= half, spans.hash(a, np.minimum(a + NAME + half, hi + span)) >> U64(40) | U64(1), U64(0))
        return [x for side in (left, right) for x in _as_bytes(side.astype(np.int64), 3)]

    def send_names(batches):
        for rows, data, offs in text_chunks(batches, "text", CHUNK):
            k, _, _, _, _, row, name, _ = kept_anchors(rows, data, offs)
            order = np.lexsort((k[row], name))
            name, ids = name[order], k[row][order]
            g = _groups(name)
            twice = ids[g] != ids[np.append(g[1:], len(ids)) - 1] if len(g) else np.zeros(0, bool)
            name = name[g]
            found = list(_by_bucket(((name >> U64(48)) % U64(buckets)).astype(np.int64), buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([_six(name[i]) for _, i in found], pa.binary()), pa.array([np.packbits(twice[i]).tobytes() for _, i in found], pa.binary())], names=["bucket", "names", "twice"])

    def shared(key, group):
        # equal ids meet in one text chunk only if they are near each other; rows of one id elsewhere count as sharing, which is harmless
        names_, twice = [], []
        for x, y in zip(group.column("names").to_pylist(), group.column("twice").to_pylist(), strict=True):
            names_.append(_from_six(x))
            twice.append(np.unpackbits(np.frombuffer(y, np.uint8))[: len(x) // 6])
        name, twice = np.concatenate(names_), np.concatenate(twice).astype(np.int64)
        order = np.argsort(name, kind="stable")
        name, g = name[order], _groups(name[order])
        more = np.diff(g, append=len(name)) + np.add.reduceat(twice[order], g) > 1 if len(g) else np.zeros(0, bool)
        slab, slots = filters.slabs(name[g][more])
        give_back()
        return pa.table({"slab": pa.array(slab, pa.int32()), "slots": pa.array(slots, pa.binary())})

    common = filters.build(docs.mapInArrow(send_names, "bucket int, names binary, twice binary").groupBy("bucket").applyInArrow(shared, filters.SLABS))
    free_exchanges(docs.sparkSession)

    def send(batches):
        sent, by = np.zeros(CACHE, U64), np.full(CACHE, 2**63 - 1)
        for rows, data, offs in text_chunks(batches, "text", CHUNK):
            k, t, copy, lo, hi, row, name, a = kept_anchors(rows, data, offs)
            size = np.diff(offs)
            c = np.flatnonzero(copy & (size >= span))
            hits = [(k[c], t[c], np.zeros(len(c), np.int64), size[c] - span)]
            i = np.flatnonzero(common.has(name & low))
            lo, hi, row, name, a, spans = lo[i], hi[i], row[i], name[i], a[i], Spans(data)
            whole = spans.hash(lo, hi + span)
            # the same string again: only the smallest document's goes on
            key = mix(name * _STEP[1] + whole)
            slot = (key & U64(CACHE - 1)).astype(np.int64)
            later = _first_of(key, k[row]) | ((sent[slot] == key) & (by[slot] < k[row]))
            sent[slot[~later]], by[slot[~later]] = key[~later], k[row][~later]
            i = np.flatnonzero(later)
            hits.append((k[row[i]], t[row[i]], lo[i] - offs[row[i]], hi[i] - offs[row[i]]))
            i = np.flatnonzero(~later)
            yield _blobs(buckets, ((name[i] >> U64(48)) % U64(buckets)).astype(np.int64), [name[i], whole[i]], row[i], lo[i] - offs[row[i]], [*_as_bytes(hi[i] - lo[i], far), *sides(spans, a[i], lo[i], hi[i])], k, t)
            hk, ht, hlo, hhi = (np.concatenate([h[j] for h in hits]) for j in range(4))
            if len(hk):
                packed = _squeeze(hk.astype("<i8"), ht.astype("<i4"), hlo.astype("<i4"), hhi.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(hk[0] % buckets)], pa.int32()), pa.array([len(hk)], pa.int32()), pa.array([b""], pa.binary()), pa.array([packed], pa.binary()), pa.array([b""], pa.binary())], names=["bucket", "n", "hashes", "places", "ids"])

    def rank(key, group):
        bucket = key[0].as_py()
        if bucket < 0:  # settled where they were found
            parts = []
            for n, packed in zip(group.column("n").to_pylist(), group.column("places").to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed)
                parts.append((np.frombuffer(raw[: 8 * n], "<i8"), *(np.frombuffer(raw[(8 + 4 * j) * n : (12 + 4 * j) * n], "<i4") for j in range(3))))
            hit = [np.concatenate([p[j] for p in parts]) for j in range(4)]
            slab, slots = [], []
        else:
            name, whole, k, t, lo, *more = _unpack(group, 2, far + 6)
            number = lambda parts: sum(m.astype(np.int64) << (8 * j) for j, m in enumerate(parts))
            more, left, right = number(more[:far]), number(more[far : far + 3]), number(more[far + 3 :])
            order = np.lexsort((k, whole, name))
            name, whole, k, t, lo, more, left, right = (x[order] for x in (name, whole, k, t, lo, more, left, right))
            u = _groups(name, whole)
            i = np.flatnonzero(k > np.repeat(k[u], np.diff(u, append=len(k))))
            hit = [k[i], t[i], lo[i], lo[i] + more[i]]
            # the first holders of each string, where the anchor agrees on one side with that of another string and document
            f = u[(_meet(name, left, whole, k) | _meet(name, right, whole, k))[u]]
            slab, slots = filters.slabs(_holder(name[f], whole[f], k[f]))
        give_back()
        n, m = len(hit[0]), len(slab)
        pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
        return pa.table([pad(hit[0], pa.int64()), *(pad(x.astype(np.int32), pa.int32()) for x in hit[1:]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(slab, pa.int32())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(slots, pa.binary())])], names=["k", "t", "lo", "hi", "slab", "slots"])

    ranked = table(docs.mapInArrow(send, _BLOB).groupBy("bucket").applyInArrow(rank, _HIT + ", slab int, slots binary"), "anchor-ranks")
    free_exchanges(docs.sparkSession)
    first = filters.build(ranked.filter("slab is not null").select("slab", "slots"))
    free_exchanges(docs.sparkSession)

    def send_windows(batches):
        for rows, data, offs in text_chunks(batches, "text", CHUNK):
            k, t, _, lo, hi, row, name, _ = kept_anchors(rows, data, offs)
            i = np.flatnonzero(common.has(name & low))
            lo, hi, row, name = lo[i], hi[i], row[i], name[i]
            i = np.flatnonzero(first.has(_holder(name, Spans(data).hash(lo, hi + span), k[row])))
            many = hi[i] - lo[i] + 1
            s = np.repeat(lo[i] - np.cumsum(many) + many, many) + np.arange(many.sum())
            r = np.repeat(row[i], many)
            h = Spans(data).hash(s, s + span)
            yield _blobs(buckets, ((h >> U64(48)) % U64(buckets)).astype(np.int64), [h], r, s - offs[r], [(h >> U64(48)) & U64(255), h >> U64(56)], k, t)

    def rank_windows(key, group):
        h, k, t, lo, x, y = _unpack(group, 1, 2)
        h |= (x.astype(U64) << U64(48)) | (y.astype(U64) << U64(56))
        i = np.flatnonzero(_first_of(h, k))
        give_back()
        i = i[np.lexsort((lo[i], t[i], k[i]))]
        k, t, lo = k[i], t[i], lo[i]
        # neighbouring starts make one run
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (lo[1:] > lo[:-1] + 1)]) if len(k) else np.zeros(0, np.int64)
        return pa.Table.from_batches([_hits(k[new], t[new], lo[new].astype(np.int32), lo[np.append(new[1:], len(k)) - 1].astype(np.int32) if len(k) else lo.astype(np.int32))])

    windows = table(docs.mapInArrow(send_windows, _BLOB).groupBy("bucket").applyInArrow(rank_windows, _HIT), "window-ranks")
    common.drop()
    first.drop()
    free_exchanges(docs.sparkSession)
    return [ranked.filter("k is not null").select("k", "t", "lo", "hi"), windows]


def _as_bytes(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [(x >> (8 * j)) & 255 for j in range(n)]


def _merge(spans: np.ndarray) -> list[tuple[int, int]]:
    """Unions of (start, end) rows that overlap or touch, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return list(zip(spans[new, 0].tolist(), reach[np.append(new[1:], len(spans)) - 1].tolist(), strict=True))


def dedup(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Every row's id and other columns (_rest), with kept (remaining bytes; whole characters of them if as_text), n_bytes, n_removed, n_spans (longest removed runs)."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.struct(*others).alias("_rest"),
    )
    rows = rows.withColumn("_t", F.shiftright("_h", 32).cast("int"))
    parts = duplicated(rows.select(F.col("_k").alias("k"), F.col("_t").alias("t"), F.col("_h").alias("h"), F.col("_text").alias("text")), span)
    found = parts[0].unionByName(parts[1])
    per_row = found.groupBy("k", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("_runs"))
    touched = filters.of_values(found.select("k"))

    kinds = {f.name: f for f in rows.schema}
    out = StructType([kinds["_rest"], *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), StructField("kept", StringType() if as_text else BinaryType())])

    def with_runs(batches):
        for b in batches:
            yield b.filter(pa.array(touched.has(b.column(0).to_numpy().astype(U64))))

    part = rows.select("_k", "_t", "_text", "_rest")
    joined = part.mapInArrow(with_runs, StructType([kinds[n] for n in ("_k", "_t", "_text", "_rest")])).join(per_row, (F.col("_k") == F.col("k")) & (F.col("_t") == F.col("t")), "left").select("_text", "_rest", F.col("_runs.lo").alias("lo"), F.col("_runs.hi").alias("hi"))

    def without_runs(batches):
        """Rows that the filter rules out have no runs and are not shuffled."""
        for b in batches:
            x = b.filter(pa.array(~touched.has(b.column(0).to_numpy().astype(U64))))
            none = pa.nulls(len(x), pa.list_(pa.int32()))
            yield from cut([pa.RecordBatch.from_arrays([x.column(2), x.column(3), none, none], names=["_text", "_rest", "lo", "hi"])])

    def cut(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, len(x), 500)):
            kept, size, removed, runs, sha = [], [], [], [], []
            for text, lo, hi in zip(b.column(0), b.column(2), b.column(3), strict=True):
                text = text.as_py()
                spans = _merge(np.column_stack([lo.values.to_numpy(), hi.values.to_numpy() + span]).astype(np.int64)) if lo.is_valid and len(lo) else []
                at, parts = 0, []
                for x, y in spans:
                    parts.append(text[at:x])
                    at = y
                parts.append(text[at:])
                left = b"".join(parts)
                removed.append(len(text) - len(left))
                size.append(len(text))
                runs.append(len(spans))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string() if as_text else pa.binary())], names=["_rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # one Python worker a task: the two branches are stages of their own
    return joined.mapInArrow(cut, out).unionByName(part.mapInArrow(without_runs, out))


def without_repeats(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated bytes cut from their texts; columns stay, n_chars follows the text if there is one.

    Where a cut leaves part of a character, that part goes too.
    """
    found = dedup(docs, span, id_col, text_col, as_text=True)
    columns = {c: F.col("kept") if c == text_col else F.length("kept").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("_rest")[c] for c in docs.columns}
    return found.select(*(v.alias(c) for c, v in columns.items()))
