"""Filters of hashed values that tasks share: Bloom filters of up to four bits a value, as large as the count of values asks for.

What a filter passes in error (0.2 to 2.4 %) is only looked at once more. It is built where the values lie: each task sends four
bytes a value, 256 groups set the bits, and the driver folds them to SLOTS bits a value at least (a power of two, at most
2**BITS: 64 MB, whatever the data; beyond some 67 million values it passes more and more in error, and what it should thin is sent in full).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import U64, mix

BITS, LEAST, SLOTS, HASHES = 29, 12, 8, 4
SLABS = "slab int, slots binary"
_ODD = tuple(U64(x) for x in (0x1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slab of each value, and the 32 bits that place it there."""
    h = mix(values * U64(0x9FB21C651E98DF25))
    return (h >> U64(56)).astype(np.int64), (h >> U64(24)) & U64(0xFFFFFFFF)


def _bit(place: np.ndarray, j: int, wide: int) -> np.ndarray:
    """A value's j-th bit in a slab of 2**wide; a smaller slab has it at the same share of its width."""
    return (((place * _ODD[j]) & U64(0xFFFFFFFF)) >> U64(32 - wide)).astype(np.int64)


def slabs(values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The places that values take, by slab: what `build` takes."""
    slab, place = _places(values)
    both = np.unique((slab.astype(U64) << U64(32)) | place)
    edges = np.searchsorted(both >> U64(32), np.arange(257, dtype=U64))
    some = np.flatnonzero(np.diff(edges))
    return some.tolist(), [(both[edges[x] : edges[x + 1]] & U64(0xFFFFFFFF)).astype("<u4").tobytes() for x in some]


class Filter:
    """Travels to tasks as one broadcast, whoever uses it; drop() ends that."""

    def __init__(self, spark, bits: np.ndarray, wide: int, hashes: np.ndarray):
        self.shared, self.wide, self.hashes = spark.sparkContext.broadcast(bits), wide, hashes

    def has(self, values: np.ndarray) -> np.ndarray:
        slab, place = _places(values)
        bits, left = self.shared.value, np.arange(len(values))
        for j in range(HASHES):
            slot = (slab << (self.wide - 8)) | _bit(place, j, self.wide - 8)
            ok = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) | (self.hashes[slab] <= j)
            slab, place, left = slab[ok], place[ok], left[ok]
        out = np.zeros(len(values), bool)
        out[left] = True
        return out

    def drop(self) -> None:
        self.shared.destroy()


def build(parts: DataFrame) -> Filter:
    """A filter of (slab, slots)."""
    wide = BITS - 8

    def merge(key, group):
        place = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in group.column("slots").to_pylist()])).astype(U64)
        hashes = max(1, min(HASHES, round(0.69 * (1 << wide) / len(place))))
        bits = np.zeros(1 << wide, bool)
        for j in range(hashes):
            bits[_bit(place, j, wide)] = True
        packed = zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(place)]), "hashes": pa.array([hashes], pa.int32()), "bits": pa.array([packed], pa.binary())})

    found = parts.groupBy("slab").applyInArrow(merge, "slab int, n long, hashes int, bits binary").collect()  # 256 rows of 256 KB at most
    total = min(BITS, max(LEAST, (SLOTS * sum(r["n"] for r in found)).bit_length()))
    each = 1 << (total - 8)
    out, hashes = np.zeros((1 << total) // 8, np.uint8), np.full(256, HASHES)
    for r in found:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8), bitorder="little")
        out[r["slab"] * each // 8 : (r["slab"] + 1) * each // 8] = np.packbits(bits.reshape(each, -1).any(1), bitorder="little")
        hashes[r["slab"]] = r["hashes"]
    return Filter(parts.sparkSession, out, total, hashes)


def of_values(values: DataFrame) -> Filter:
    """A filter of a column of longs."""

    def each(batches):
        for b in batches:
            slab, raw = slabs(b.column(0).to_numpy().astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(slab, pa.int32()), pa.array(raw, pa.binary())], names=["slab", "slots"])

    return build(values.mapInArrow(each, SLABS))
