"""Shared parts of the text operators: shared-folder tables, Arrow text chunks, vectorised hashing of words.

Texts are read as the byte buffers that Arrow holds, a few MB at a time, and hashed with numpy; a null
text counts as empty everywhere. One text that is longer than a chunk is a chunk of its own, never cut; a worker then
needs some 60 bytes of memory for each of its bytes, and gives them back after it.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
PER_FILE = 250_000
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only where that is unset (tests), a local one, then set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.tablewright.localShared", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="tablewright-")
            spark.conf.set("spark.tablewright.localShared", at)
    return at.rstrip("/")


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: what follows no longer depends on lost executors.

    rows: about how many there are, if they are short and known: a task then writes PER_FILE of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tablewright/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, rows // PER_FILE))
    else:
        free_heaps(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes what table() wrote; nothing may read it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_exchanges(spark: SparkSession) -> None:
    """Lets Spark delete the exchange files of plans that nothing refers to any more; it does so when the driver's JVM collects garbage, which is rare."""
    gc.collect()
    spark._jvm.System.gc()


def free_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect all garbage, after which they hand free heap back to the system.

    Left alone, a heap only grows towards its limit from one step to the next, and the workers' memory comes on top of it. One
    task for each core: they start together, so each executor has one, and a second one finds little to do.
    """
    sc = spark.sparkContext
    tasks = 1 if sc.master == "local" or sc.master.startswith("local[") else sc.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def buckets_for(df: DataFrame, entries: int, per_bucket: int) -> int:
    """How many buckets hold about per_bucket entries each, and no fewer than the session's shuffle partitions."""
    return max(input_slices(df), -(-entries // per_bucket))


def input_slices(df: DataFrame) -> int:
    """A partition count that follows the session's shuffle setting, which the cluster sizes for its data."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_fold(column: str = "doc_id", mod: int = 5):
    """crc32 of the id as text, modulo mod; 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


_libc = ctypes.CDLL(ctypes.util.find_library("c"))


def give_back() -> None:
    """Hands memory that is free in this process back to the system: workers wait for later tasks beside new ones."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) for runs of rows with about max_bytes of text; nulls are empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if col.null_count:
            col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
        if not len(col):
            continue
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
            hi = min(hi, len(col), lo + max_rows)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n. Those of a chunk are kept; a longer text's go with it."""
    if n <= CHUNK_BYTES + 1 and _powers:
        return _powers[0][:n], _powers[1][:n]
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(max(n, CHUNK_BYTES + 1), U64(base))
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    if n <= CHUNK_BYTES + 1:
        _powers[:] = found
    return found[0][:n], found[1][:n]


class Spans:
    """Prefix sums of a polynomial hash modulo 2**64 over random byte values: any span's hash in O(1)."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_LOWER if lower else _BYTES)[data] * power[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def spans_outside(between: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes that `between` (by byte value) does not mark, and the row that holds it."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`, and the row that holds it."""
    return spans_outside(_SPACE, data, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word with A-Z lower-cased, and its row."""
    start, end, row = word_spans(data, offs)
    return Spans(data, lower=True).hash(start, end), row
