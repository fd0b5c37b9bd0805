"""Sources and sinks: delimited text, Parquet, JSON, JDBC, binary volumes, catalogue metadata."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = ("", "NaN", "NA", "N/A", "null", "NULL", ".")


def read_table(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",", missing: Sequence[str] = MISSING, schema: str | None = None) -> DataFrame:
    """CSV, TSV, JSON or Parquet with missing tokens and NaN as NULL. Without a schema, columns that hold only numbers become doubles."""
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt == "json":
        return nan_to_null(spark.read.schema(schema).json(path) if schema else spark.read.json(path))
    df = spark.read.csv(path, sep="\t" if fmt == "tsv" else sep, header=True, schema=schema)
    df = df.select(*(F.when(~F.trim(c).isin(list(missing)), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    if schema:
        return nan_to_null(df)
    bad = df.agg(*(F.sum((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("long")).alias(c) for c in df.columns)).first()
    return nan_to_null(df.select(*(F.col(c).cast("double").alias(c) if not bad[c] else F.col(c) for c in df.columns)))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def roles(df: DataFrame, case: str, label: str | None, covariates: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column roles; what is left over are features."""
    used = {case, label, *covariates}
    unknown = used - set(df.columns) - {None}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return {"case": [case], "label": [label] if label else [], "covariates": list(covariates), "features": [c for c in df.columns if c not in used]}


def correspond(df: DataFrame, names: dict[str, str], features: Sequence[str]) -> DataFrame:
    """Holdout columns under the discovery names; an error for a feature that neither has."""
    back = {v: k for k, v in names.items()}
    lost = [f for f in features if back.get(f, f) not in df.columns]
    if lost:
        raise ValueError(f"features without a column: {lost}")
    return df.select(*(F.col(back.get(f, f)).alias(f) for f in features))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    {"parquet": lambda: w.parquet(path), "json": lambda: w.json(path), "csv": lambda: w.csv(path, sep=sep, header=True), "tsv": lambda: w.csv(path, sep="\t", header=True)}[fmt]()


def export_results(df: DataFrame, path: str, fmt: str = "csv", about: dict | None = None, mode: str = "errorifexists") -> None:
    """A result table in path/table and what it is about (own entries, columns and their types) as one line of JSON in path/about."""
    write_table(df, f"{path}/table", fmt, mode=mode)
    line = json.dumps({**(about or {}), "columns": dict(df.dtypes)}, sort_keys=True)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/about")


def linked(spark: SparkSession, value: DataFrame | str, fmt: str = "parquet") -> DataFrame:
    """The table itself, or the one at a path: read only when it is used."""
    return read_table(spark, value, fmt) if isinstance(value, str) else value


def find_in_json(df: DataFrame, column: str, wanted: Callable) -> DataFrame:
    """Adds paths: where in a JSON text the values stand that `wanted` accepts (any depth, objects and lists too), in reading order.

    Text that is not JSON has none; a missing text has null.
    """

    def walk(v, at: str):
        if wanted(v):
            yield at
        inside = ((f".{n}", x) for n, x in v.items()) if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v)) if isinstance(v, list) else ()
        for step, x in inside:
            yield from walk(x, at + step)

    def one(text: str | None):
        if text is None:
            return None
        try:
            return list(walk(json.loads(text), "$"))
        except ValueError:
            return []

    return df.withColumn("paths", F.pandas_udf(lambda s: s.map(one, na_action=None), "array<string>")(F.col(column)))


def jdbc_table(spark: SparkSession, url: str, table: str, columns: Sequence[str], limit: int | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Named columns of a database table; `partition` (column, low, high, parts) reads in parallel. Selection and limit are pushed down."""
    if not columns:
        raise ValueError("name at least one column")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        c, lo, hi, n = partition
        r = r.options(partitionColumn=c, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(n))
    df = r.load().select(*columns)
    return df.limit(limit) if limit else df


def jdbc_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()


def describe(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table: name, position, type."""
    return df.sparkSession.createDataFrame([(name, c, i, t) for i, (c, t) in enumerate(df.dtypes)], "table_name string, column_name string, position int, type string")


def decode_nifti(raw: bytes) -> np.ndarray:
    """Values of a NIfTI-1 volume, scaled, in file order."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim, kind, (offset, slope, inter) = struct.unpack(end + "8h", raw[40:56]), struct.unpack(end + "h", raw[70:72])[0], struct.unpack(end + "3f", raw[108:120])
    dtype = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[kind]
    x = np.frombuffer(raw, end + dtype, int(np.prod(dim[1 : dim[0] + 1])), int(offset)).astype(float)
    return x * slope + inter if slope else x


def read_volumes(spark: SparkSession, path: str, mask: Sequence[int] | None = None) -> DataFrame:
    """path, values: one row for each volume file, only voxels in the mask (their numbers) if one is given."""
    at = None if mask is None else np.asarray(mask)

    def each(batches):
        for p in batches:
            yield pd.DataFrame({"path": p["path"], "values": [(v if at is None else v[at]).tolist() for v in map(decode_nifti, p["content"])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, values array<double>")


def scramble(df: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """Uniform random numbers in place of the columns, for sharing a table's shape."""
    return df.withColumns({c: F.rand(seed + i) for i, c in enumerate(columns)})
