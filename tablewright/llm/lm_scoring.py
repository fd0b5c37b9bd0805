"""LM scoring: a smoothed bigram model in Elias-Fano n-gram tries, one for each shard of contexts.

Tokens are words with A-Z lower-cased, then one end. The log10 probability of a text is that of its first token as a unigram,
then of each token after the one before it:

    seen in training:   (count(a b) - DISCOUNT) / count(a)
    else:               back(a) * p(b),   back(a) = DISCOUNT * types(a) / count(a), or 1 where a was never seen

with p(b) = (count(b) + 0.1) / (N + 0.1 (V + 1)). The mass that back(a) hands on also reaches seen successors, whose p(b)
it does not use, so probabilities add up to at most one.

All occurrences (context, successor, text) are dealt out by context. A task builds the trie of its contexts from the training
occurrences: a sorted vocabulary, pointers from each context to its successors, the successors themselves (made
increasing over all contexts by what the contexts before have used), each level Elias-Fano coded, and 8-bit codes of
smoothed probabilities. The levels lie in anonymous memory maps, which the task gives back when the shard is scored; no file is written. Each distinct occurrence is looked up by a
successor search relative to its context. Sums of each text go on to a task that has the text's bucket; for held-out texts
also what only the shards of two neighbouring words know together: p of a word, and that its pair was not seen.

Contexts of a 1/4096th of all tokens or more (a list of 8192 at most) are split over all shards by successor.

Null text: empty, the end alone. A null id is held out or not as crc32 of null is null: it is learnt from. Rows that share an id are told
apart by their texts, equal rows count and return as often as they occur. An empty table gives an empty result. Texts of any length are read
whole. Other columns play no part, whatever their names. The number of shards follows the number of words (PER_SHARD).
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buckets_for, give_back, mix, release, table, text_chunks, word_hashes

DISCOUNT, ADD, HOT = 0.75, 0.1, 4096
LOW = U64((1 << 48) - 1)
FLUSH, PER_SHARD = 1 << 22, 3 << 20  # tokens that a task holds back before it sends them, and that meet in a shard
BASE_BITS, MODEL_BITS = 20, 16  # binary places of partial sums on their way to a text; model probabilities have 8 bits anyway
END = mix(np.array([0x3C2F733E], U64))[0]


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit in each word."""
    at, k = np.zeros(len(words), np.int64), k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count((words >> at.astype(U64)) & ((U64(1) << U64(width)) - U64(1))).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, in memory maps.

    next_geq finds the first element from `start` on that reaches a value, by the zeros of the unary part.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> U64(self.low_bits)).astype(np.int64)
        bits = np.zeros(((self.n + (high[-1] if self.n else 0) + 1 + 63) // 64 + 1) * 64, bool)
        bits[high + np.arange(self.n)] = True
        upper = np.packbits(bits, bitorder="little").view("<u8").astype(U64)
        self.upper = _mapped(upper)
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(upper).astype(np.int64))]
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones
        packed = np.zeros((self.n * self.low_bits + 63) // 64 + 2, U64)
        if self.low_bits:
            low = values & ((U64(1) << U64(self.low_bits)) - U64(1))
            at = np.arange(self.n) * self.low_bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(packed, word, low << shift)
            over = np.flatnonzero(shift + U64(self.low_bits) > 64)
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (U64(64) - shift[over]))
        self.packed = _mapped(packed)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U64)
        x = self.packed[word] >> shift
        over = shift + U64(self.low_bits) > 64
        x = np.where(over, x | (self.packed[word + 1] << ((U64(64) - shift) & U64(63))), x)
        return x & ((U64(1) << U64(self.low_bits)) - U64(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        at = 64 * w + _select(self.upper[w], i - self.ones[w])
        return ((at - i).astype(U64) << U64(self.low_bits)) | self.low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a high part less than each of these."""
        k = high - 1
        known = np.clip(k, 0, self.zeros[-1] - 1)
        w = np.searchsorted(self.zeros, known, "right") - 1
        at = 64 * w + _select(~self.upper[w], known - self.zeros[w])
        return np.where(k < 0, 0, np.minimum(at - known, self.n))

    def next_geq(self, value: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element in [start, stop) that reaches value (stop if none), and whether it is equal."""
        if not self.n:
            return stop.copy(), np.zeros(len(value), bool)
        high = np.minimum(value >> U64(self.low_bits), U64(self.zeros[-1])).astype(np.int64)
        want = value & ((U64(1) << U64(self.low_bits)) - U64(1)) if self.low_bits else np.zeros(len(value), U64)
        lo = np.maximum(self._below(high), start)
        hi = end = np.maximum(lo, np.minimum(self._below(high + 1), stop))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            less = self.low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi = hi.copy()
            hi[live[~less]] = mid[~less]
        inside = lo < end
        equal = np.zeros(len(value), bool)
        i = np.flatnonzero(inside)
        equal[i] = self.low(lo[i]) == want[i]
        return lo, equal


def _mapped(x: np.ndarray) -> np.ndarray:
    """The array in a memory map of its own, which goes back to the system with it."""
    if not x.nbytes:
        return x
    out = np.frombuffer(mmap.mmap(-1, x.nbytes), x.dtype)
    out[:] = x
    return out


def codebook(x: np.ndarray, weight: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the values they stand for: each value itself if there are few, else means over equal shares of the weight."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    u, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weight)
    part = np.arange(len(u)) if len(u) <= size else np.minimum(((np.cumsum(w) - w) * size / w.sum()).astype(np.int64), size - 1)
    _, part = np.unique(part, return_inverse=True)
    return part[inverse].astype(np.uint8), np.bincount(part, u * w) / np.bincount(part, w)


class Trie:
    """Contexts and successors of a shard with 8-bit log10 probabilities."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count: np.ndarray, total: np.ndarray):
        """Distinct pairs sorted by (a, b), their training counts, and each context's count (aligned with pairs)."""
        contexts, first = np.unique(a, return_index=True)
        self.vocabulary = EliasFano(np.unique(b))
        self.contexts = EliasFano(contexts)
        types = np.diff(first, append=len(a))
        self.pointers = EliasFano(np.append(first, len(a)).astype(U64))
        ids, _ = self.vocabulary.next_geq(b, np.zeros(len(b), np.int64), np.full(len(b), self.vocabulary.n))
        last = ids[first + types - 1] if len(a) else ids
        self.base = EliasFano((np.cumsum(last + 1) - (last + 1)).astype(U64))
        self.successors = EliasFano((ids + np.repeat(np.cumsum(last + 1) - (last + 1), types)).astype(U64))
        code, self.values = codebook(np.log10((count - DISCOUNT) / total), count)
        self.codes = _mapped(code)
        weight = total[first] if len(a) else np.zeros(0)
        code, self.back_values = codebook(np.log10(DISCOUNT * types / np.maximum(weight, 1)), weight)
        self.back_codes = _mapped(code)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the pair was seen; its log10 probability, or the context's log10 back-off; whether the context was seen."""
        every = np.zeros(len(a), np.int64)
        seen, known, value = np.zeros(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a))
        if not self.contexts.n:
            return seen, value, known
        c, known = self.contexts.next_geq(a, every, every + self.contexts.n)
        w, word = self.vocabulary.next_geq(b, every, every + self.vocabulary.n)
        i = np.flatnonzero(known)
        value[i] = self.back_values[self.back_codes[c[i]]]
        i = np.flatnonzero(known & word)
        start, stop = self.pointers.access(c[i]).astype(np.int64), self.pointers.access(c[i] + 1).astype(np.int64)
        at, hit = self.successors.next_geq(w[i].astype(U64) + self.base.access(c[i]), start, stop)
        seen[i] = hit
        value[i[hit]] = self.values[self.codes[at[hit]]]
        return seen, value, known


def _z(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64)


def _planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers to 2**-bits, as byte planes: the high ones are nearly empty."""
    v = np.round(x * (1 << bits)).astype(np.int64)
    return np.ascontiguousarray(((v << 1) ^ (v >> 63)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(raw: np.ndarray, bits: int) -> np.ndarray:
    v = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()
    return ((v >> U64(1)).astype(np.int64) ^ -(v & U64(1)).astype(np.int64)) / (1 << bits)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(raw), 0

    def take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        self.at += size
        return np.frombuffer(self.raw[self.at - size : self.at], kind)


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _split(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def hot_words(texts: DataFrame, groups: int = 64) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes and training counts of the words that make up 1/HOT of all training words or more; training words, training texts.

    A word that frequent is so in one part of the input at least; each part names its own (HOT at most), their
    counts are then taken over all parts. Merging keeps those whose named counts reach half the share: 2 * HOT at most.
    """

    def name(batches):
        words, counts, total, docs = np.zeros(0, U64), np.zeros(0, np.int64), 0, 0
        for rows, data, offs in text_chunks(batches, "text"):
            train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            h, row = word_hashes(data, offs)
            h = h[train[row]]
            docs += int(train.sum())
            total += len(h)
            u, c = np.unique(h, return_counts=True)
            keep = c * HOT >= len(h)  # in each chunk again, so that little is held
            u, inverse = np.unique(np.r_[words, u[keep]], return_inverse=True)
            counts, words = np.bincount(inverse, np.r_[counts, c[keep]], len(u)).astype(np.int64), u
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["w", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([-1 - total, -1 - docs], pa.int64())], names=["w", "n"])

    named = table(texts.mapInArrow(name, "w long, n long"), "hot-names")
    totals = {r["w"]: r["n"] for r in named.filter("n < 0").groupBy("w").agg((-F.sum(F.col("n") + 1)).alias("n")).collect()}
    total, docs = totals.get(0, 0), totals.get(1, 0)
    found = named.filter("n >= 0").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * HOT >= total).orderBy(F.col("n").desc(), "w").limit(2 * HOT).collect()
    hot = np.sort(np.array([r["w"] for r in found], np.int64).view(U64))

    def count(batches):
        n = np.zeros(len(hot), np.int64)
        for rows, data, offs in text_chunks(batches, "text"):
            train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            h, row = word_hashes(data, offs)
            h = h[train[row]]
            at = np.searchsorted(hot, h)
            at = at[(at < len(hot)) & (hot[np.minimum(at, max(len(hot) - 1, 0))] == h)] if len(hot) else at[:0]
            n += np.bincount(at, minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["i", "n"])

    counts = np.zeros(len(hot), np.int64)
    if len(hot):
        for r in texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 2 * HOT rows at most
            counts[r["i"]] = r["n"]
    release(named)
    return hot, counts, total, docs


_PACK = "to int, n int, packed binary"


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. train: a boolean column, null counts as true."""
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k"), F.shiftright(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 32).cast("int").bitwiseAND(-2).bitwiseOR(F.col(id_col).isNull().cast("int")).alias("t"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    hot, hot_counts, train_words, train_docs = hot_words(texts)
    shards = buckets_for(docs, train_words, PER_SHARD)

    def hot_index(h: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        return np.where(hot[at] == h, at, -1)

    def occurrences(batches):
        """For each shard: contexts, successors, texts, and places in held-out texts. For each text bucket: its texts."""
        held: list[list] = [[] for _ in range(5)]

        def flush():
            k, t, tr, n_words = (np.concatenate(c) for c in held[:4])
            h = np.concatenate(held[4])
            for c in held:
                c.clear()
            row = np.repeat(np.arange(len(k), dtype=np.int32), n_words)
            begin = np.cumsum(n_words) - n_words
            out: list[tuple[int, int, bytes]] = []
            for bucket, i in _split((mix(k.astype(U64)) % U64(shards)).astype(np.int64), shards):
                out.append((-1 - bucket, len(i), _z(k[i].astype("<i8"), t[i].astype("<i4"), tr[i].astype(np.uint8), n_words[i].astype("<i4"))))

            def following(i: np.ndarray) -> np.ndarray:
                after = np.minimum(i + 1, len(h) - 1)
                return np.where((after > i) & (row[after] == row[i]), h[after], END)

            to = np.empty(len(h), np.int32)
            for lo in range(0, len(h), 1 << 18):
                part = h[lo : lo + (1 << 18)]
                to[lo : lo + len(part)] = (part >> U64(48)).astype(np.int64) % shards
                i = np.flatnonzero(hot_index(part) >= 0) + lo
                to[i] = (mix(following(i)) >> U64(48)).astype(np.int64) % shards
            for bucket, i in _split(to, shards):
                i = i[np.argsort(h[i], kind="stable")]
                a, pos = h[i], i - begin[row[i]]
                g = _runs(a)
                used, idx = np.unique(row[i], return_inverse=True)
                far = np.flatnonzero(tr[row[i]] == 0)
                firsts = np.flatnonzero(pos == 0)
                after, which = np.unique(following(i) & LOW, return_inverse=True)
                raw = _z(
                    np.array([len(g), len(used), len(far), len(firsts), len(after)], "<i8"), _six(a[g] & LOW), (a[g] >> U64(48)).astype("<u2"), np.diff(g, append=len(i)).astype("<i4"),
                    _six(after), (which & 0xFFFF).astype("<u2"), (which >> 16).astype("<u2"), idx.astype("<i4"), np.diff(k[used], prepend=0).astype("<i8"), t[used].astype("<i4"), tr[used].astype(np.uint8),
                    far.astype("<i4"), pos[far].astype("<i4"), firsts.astype("<i4"),
                )
                out.append((bucket, len(i), raw))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["to", "n", "packed"])

        size = 0
        for rows, data, offs in text_chunks(batches, "text"):
            h, row = word_hashes(data, offs)
            for c, v in zip(held, (rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), np.bincount(row, minlength=len(rows)), h), strict=True):
                c.append(v.copy())
            size += len(h) + len(rows)
            if size > FLUSH:
                yield flush()
                give_back()
                size = 0
        if held[0]:
            yield flush()

    def shard(key, group):
        bucket = key[0].as_py()
        out: list[tuple[int, int, int, bytes]] = []  # text bucket, kind, n, packed
        if bucket < 0:
            out = [(-1 - bucket, 0, n, p) for n, p in zip(group.column("n").to_pylist(), group.column("packed").to_pylist(), strict=True)]
        else:
            parts: list[list] = [[] for _ in range(5)]
            who: list[list] = [[], [], []]
            n_docs = 0
            for n, packed in zip(group.column("n").to_pylist(), group.column("packed").to_pylist(), strict=True):
                r = _Reader(packed)
                g, m, far, firsts, after = r.take("<i8", 5).tolist()
                a = _wide(r.take(np.uint8, 6 * g).tobytes()) | (r.take("<u2", g).astype(U64) << U64(48))
                a = np.repeat(a, r.take("<i4", g))
                words = _wide(r.take(np.uint8, 6 * after).tobytes())
                b = words[r.take("<u2", n) | (r.take("<u2", n).astype(np.uint32) << 16)]
                idx = r.take("<i4", n) + np.int32(n_docs)
                for w, x in zip(who, (np.cumsum(r.take("<i8", m)), r.take("<i4", m), r.take(np.uint8, m)), strict=True):
                    w.append(x)
                pos = np.full(n, -1, np.int32)  # in held-out texts only
                at = r.take("<i4", far)
                pos[at] = r.take("<i4", far)
                first = np.zeros(n, bool)
                first[r.take("<i4", firsts)] = True
                for p, x in zip(parts, (a, b, idx, pos, first), strict=True):
                    p.append(x)
                n_docs += m
            for j in range(5):  # one column at a time, to hold none twice
                parts[j] = np.concatenate(parts[j])
            k, t, tr = (np.concatenate(w) for w in who)
            give_back()
            order = np.lexsort((parts[1], parts[0])).astype(np.int32)
            for j in range(5):
                parts[j] = parts[j][order]
            a, b, idx, pos, first = parts
            del order, parts
            learnt = tr[idx].astype(np.int64)
            g, p = _runs(a), np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            own = np.add.reduceat(learnt, g)  # training count of each context in this shard
            h = hot_index(a[g])
            total = np.where(h >= 0, hot_counts[h] if len(hot) else 0, own)
            of = np.searchsorted(g, p, "right") - 1
            pair = np.add.reduceat(learnt, p)
            keep = np.flatnonzero(pair > 0)
            trie = Trie(a[p][keep], b[p][keep], pair[keep], total[of][keep])
            seen, value, known = trie.look_up(a[p], b[p])
            types = np.bincount(of[keep], minlength=len(g))
            hots = np.flatnonzero(h >= 0)
            out.append((-1, 1, len(hots), _z(h[hots].astype("<i8"), types[hots].astype("<i8"))))
            out.append((-1, 2, int((own[h < 0] > 0).sum()), b""))
            size = np.diff(p, append=len(a))
            del a, b
            ctx, seen, value = np.repeat(of.astype(np.int32), size), np.repeat(seen, size), np.repeat(value, size)
            log_c = np.log10(total + ADD)[ctx]
            is_hot = h[ctx] >= 0
            # a split context's back-off is known only when all shards are done; so is whether it was seen at all
            settled = np.where(seen | ~is_hot, value, 0.0)
            base = np.bincount(idx, log_c, n_docs)
            lm = np.bincount(idx, settled + np.where(first, log_c, 0.0), n_docs)
            n_known = np.bincount(idx, (total > 0)[ctx], n_docs).astype(np.int64)
            dest = (mix(k.astype(U64)) % U64(shards)).astype(np.int64)
            for d, i in _split(dest, shards):
                out.append((d, 3, len(i), _z(np.diff(k[i], prepend=0).astype("<i8"), t[i].astype("<i4"), _planes(base[i], BASE_BITS), _planes(lm[i], MODEL_BITS), n_known[i].astype("<i4"))))
            f = np.flatnonzero(tr[idx] == 0)
            for d, i in _split(dest[idx[f]], shards):
                i = f[i]
                used, j = np.unique(idx[i], return_inverse=True)
                miss = np.where(seen[i], -2, h[ctx[i]])  # -2: seen; -1: settled back-off; else the split context's index
                out.append((d, 4, len(i), _z(np.array([len(used)], "<i8"), k[used].astype("<i8"), t[used].astype("<i4"), j.astype("<i4"), pos[i].astype("<i4"), log_c[i].astype("<f4"), miss.astype("<i2"))))
        give_back()
        return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], names=["to", "kind", "n", "packed"])

    dealt = table(texts.mapInArrow(occurrences, _PACK).groupBy("to").applyInArrow(shard, "to int, kind int, n int, packed binary"), "lm-shards")
    types = np.zeros(len(hot), np.int64)
    for r in dealt.filter("kind = 1").select("n", "packed").toLocalIterator():  # each at most 2 * HOT pairs
        x = _Reader(bytes(r["packed"]))
        i, n = x.take("<i8", r["n"]), x.take("<i8", r["n"])
        np.add.at(types, i, n)
    distinct = (dealt.filter("kind = 2").agg(F.sum("n").alias("n")).first()["n"] or 0) + int((hot_counts > 0).sum()) + (train_docs > 0)
    n_train = train_words + train_docs
    scale = float(np.log10(n_train + ADD * (distinct + 1)))
    back = np.log10(np.maximum(DISCOUNT * types, 1e-300) / np.maximum(hot_counts, 1)) if len(hot) else np.zeros(1)
    back[: len(hot)][hot_counts == 0] = 0.0
    end_log = float(np.log10(train_docs + ADD))

    def finish(key, group):
        head: list[list] = [[] for _ in range(4)]
        sums: list[list] = [[] for _ in range(5)]
        far: list[list] = [[] for _ in range(5)]
        for kind, n, packed in zip(*(group.column(c).to_pylist() for c in ("kind", "n", "packed")), strict=True):
            r = _Reader(packed)
            if kind == 0:
                cols, to = [r.take(x, n) for x in ("<i8", "<i4", np.uint8, "<i4")], head
            elif kind == 3:
                cols, to = [np.cumsum(r.take("<i8", n)), r.take("<i4", n), *(_from_planes(r.take(np.uint8, 8 * n), bits) for bits in (BASE_BITS, MODEL_BITS)), r.take("<i4", n)], sums
            else:
                m = int(r.take("<i8", 1)[0])
                k, t = r.take("<i8", m), r.take("<i4", m)
                j = r.take("<i4", n)
                cols, to = [k[j], t[j], *(r.take(x, n) for x in ("<i4", "<f4", "<i2"))], far
            for c, v in zip(to, cols, strict=True):
                c.append(v)
        k, t, tr, n_words = (np.concatenate(c) for c in head)
        both = lambda x, y: np.rec.fromarrays([x, y], names="k,t")
        rows, inverse, times = np.unique(both(k, t), return_inverse=True, return_counts=True)
        words = np.zeros(len(rows), np.int64)
        words[inverse] = n_words
        base, lm, known = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        if sums[0]:
            x = [np.concatenate(c) for c in sums]
            at = np.searchsorted(rows, both(x[0], x[1]))
            base, lm, known = (np.bincount(at, x[j], len(rows)) / times for j in (2, 3, 4))
        uses = (words > 0).astype(float)  # how often p(b) is used, each with the same divisor
        if far[0]:
            x = [np.concatenate(c) for c in far]
            at = np.searchsorted(rows, both(x[0], x[1]))
            pos, log_c, miss = x[2].astype(np.int64), x[3].astype(float), x[4].astype(np.int64)
            order = np.lexsort((pos, at))
            at, pos, log_c, miss = at[order], pos[order], log_c[order], miss[order]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (pos[1:] != pos[:-1])])  # equal rows say the same
            at, pos, log_c, miss = at[new], pos[new], log_c[new], miss[new]
            # entry i says how word i follows; the next entry of the text says how likely that word is by itself
            following = np.append(log_c[1:], 0.0)
            last = np.append(at[1:] != at[:-1], True)
            p = np.where(last, end_log, following)
            unseen = miss != -2
            lm += np.bincount(at, np.where(unseen, p + np.where(miss >= 0, back[np.maximum(miss, 0)], 0.0), 0.0), len(rows))
            uses += np.bincount(at, unseen, len(rows))
        alone = words == 0
        lm = np.where(alone, end_log, lm)
        uses = np.where(alone, 1.0, uses)
        n_tokens = words + 1
        got = [base + end_log - n_tokens * scale, lm - uses * scale]
        # with nothing to learn from there is no model; both scores are then those of one unseen token each
        i = inverse.ravel()
        ids = pa.array(k, mask=(t & 1).astype(bool))
        give_back()
        return pa.table([ids, pa.array(tr == 0), pa.array(n_tokens[i]), pa.array(np.round(known).astype(np.int64)[i] + (train_docs > 0)), pa.array(np.full(len(k), n_train, np.int64)), pa.array(got[0][i]), pa.array(got[1][i])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.filter("kind in (0, 3, 4)").groupBy("to").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
