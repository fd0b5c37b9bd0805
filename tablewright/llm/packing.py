"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only lengths matter to a packing, so the instance is the histogram of piece lengths: `capacity` numbers,
however many documents there are. On it, sets that provably dominate every alternative for an item are
fixed first; best-fit decreasing packs what is left. The result is a list of patterns (the lengths in a
sequence) with multiplicities; pieces then take the patterns' slots by their rank among those of their
length, ranked in salted buckets so that no length is counted off by one task.

Null text: empty, a piece of one token. Null ids, ties and repeated rows are pieces like others. Texts of any
length are read whole. An empty table gives an empty result. Other columns of documents play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import table, text_chunks

CAPACITY, END = 1024, 2
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE = 300_000  # words that a worker keeps, twice: those of late, and those before them


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids of whole texts, as little-endian bytes.

    A space between two other visible characters always begins a pre-token, so a text is cut there and
    each part is looked up; parts not seen yet are merged from the same vocabulary's ranks. Texts that hold
    a special token go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.whole = path, None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        marks = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        chars = {chr(b): b for b in marks} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in marks)}
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        import public_tokenizers

        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        """Ids of a space and the text, which is looked up first."""
        got = self.known.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                got = np.array(self.merge(" " + text), "<u4").tobytes()
            if len(text) < 64:
                if len(self.known) >= CACHE:
                    self.older, self.known = self.known, {}
                self.known[text] = got
        return got

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        first, rest = np.array(self.merge(parts[0]), "<u4").tobytes(), parts[1:]
        got = list(map(self.known.get, rest))
        if None in got:
            got = [self.part(p) if g is None else g for p, g in zip(rest, got, strict=True)]
        return first + b"".join(got)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and `end`, cut where longer than capacity; the first piece takes the odd length."""

    def each(batches):
        encode, tail = encoder(path), np.array([end], "<u4").tobytes()
        for batch, _, _ in text_chunks(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(cols, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, tuple[int, ...]]


def reduce(count: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Fixes dominating sets; takes them out of count (index: length) and returns them.

    For an item, a set that fits with it dominates when any other set that fits could be exchanged for
    it part by part. That holds for: the item alone when nothing fits with it; a pair that fills the sequence; the
    largest partner when two others never fit; and, when three others never fit, the largest partner
    with a second one at least as large as the smaller item of any pair that fits.
    """
    fixed: list[Pattern] = []

    def take(n: int, *lengths: int) -> None:
        fixed.append((n, lengths))
        for x in lengths:
            count[x] -= n

    def largest(most: int, without: int = 0) -> int:
        """The largest length up to `most` of which more than those in use are left."""
        for x in range(min(most, capacity), 0, -1):
            if count[x] > (x == without):
                return x
        return 0

    def smallest(n: int, without: int) -> int:
        """Sum of the n smallest items besides one of `without`; over capacity if there are fewer."""
        total, left = 0, n
        for x in np.flatnonzero(count):
            k = min(left, int(count[x]) - (x == without))
            total, left = total + k * int(x), left - k
            if not left:
                return total
        return capacity + 1

    moved = True
    while moved:
        moved = False
        for w in range(capacity, 0, -1):
            while count[w]:
                room = capacity - w
                best = largest(room, w)
                if not best:
                    take(int(count[w]) if smallest(1, w) > room and 2 * w > capacity else 1, w)
                elif best == room:
                    take(int(count[w]) // 2 if w == best else int(min(count[w], count[best])), w, best)
                elif smallest(2, w) > room:
                    take(int(count[w]) // 2 if w == best else int(min(count[w], count[best])), w, best)
                elif smallest(3, w) > room:
                    count[w] -= 1
                    count[best] -= 1
                    second = largest(room - best)
                    count[best] += 1
                    # the smaller item of any pair that fits
                    y = next((y for y in range(room // 2, 0, -1) if count[y] and (count[y] > 1 or any(count[y + 1 : room - y + 1]))), 0)
                    count[w] += 1
                    if not second or second < y:
                        break
                    # what fits only gets less, so the same set dominates as long as it can be had
                    take(int(min(count[x] // (w, best, second).count(x) for x in {w, best, second})), w, best, second)
                else:
                    break
                moved = True
    return fixed


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over a histogram: many equal items enter many equally full sequences at once."""
    room: dict[int, list[Pattern]] = defaultdict(list)
    for w in range(capacity, 0, -1):
        n = int(count[w])
        while n:
            r = next((r for r in range(w, capacity) if room[r]), None)
            if r is None:
                k = min(capacity // w, n)
                many = n // k
                room[capacity - k * w].append((many, (w,) * k))
                n -= many * k
            else:
                many, lengths = room[r].pop()
                used = min(many, n)
                if many > used:
                    room[r].append((many - used, lengths))
                room[r - w].append((used, (*lengths, w)))
                n -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for xs in room.values():
        for many, lengths in xs:
            merged[lengths] += many
    return [(n, x) for x, n in merged.items()]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    left = count.copy()
    return reduce(left, capacity) + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Runs of ranks for each length: keys sorted by (length, first rank), and what each run takes."""
    next_rank: dict[int, int] = defaultdict(int)
    runs, offsets, seq = [], [], 0
    for many, lengths in patterns:
        at, where = 0, defaultdict(list)
        for x in lengths:
            where[x].append(at)
            at += x
        for x, places in where.items():
            runs.append((x, next_rank[x], seq, len(places), len(offsets)))
            offsets += places
            next_rank[x] += many * len(places)
        seq += many
    runs.sort()
    return *(np.array([r[k] for r in runs], np.int64) for k in range(5)), np.array(offsets, np.int64)


def pack(cut: DataFrame, capacity: int = CAPACITY, per_bucket: int = 1000, most_buckets: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and any more columns; ones of these two names are replaced)."""
    cut = table(cut, "pieces")
    rows = cut.groupBy("length").count().collect()  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["count"]
    length, first, seq, copies, at, offset = slots(plan(count, capacity))
    key = (length << 44) + first
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]

    def place(batches):
        for b in batches:
            x, rank = b.column("len").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, (x << 44) + rank, "right") - 1
            local = rank - first[k]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(seq[k] + local // copies[k]), pa.array(offset[at[k] + local % copies[k]])], names=["row", "sequence_id", "offset"])

    # a length has buckets for its number of pieces, so none is counted off by one task
    many = F.array(*(F.lit(max(1, int(c) // max(per_bucket, int(count.sum()) // most_buckets))) for c in count))
    salted = cut.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("length").alias("len")).withColumn("bucket", F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.get(many, F.col("len").cast("int"))))
    before = salted.groupBy("len", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("len", "bucket").orderBy("row.doc_id", "row.piece", "row.ids_crc32")))
    ranked = ranked.join(before, ["len", "bucket"]).select("row", "len", (F.col("nth") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))
    out = StructType([ranked.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, out).select("row.*", "sequence_id", "offset")
