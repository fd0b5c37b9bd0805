"""Structured Streaming over event tables: windows with watermarks, sessions, and running class references.

Every function takes a static or a streaming frame alike; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Times with a zone, as watermarks need; a watermark on a stream."""
    x = events.withColumn(time, F.col(time).cast("timestamp"))
    return x.withWatermark(time, late) if events.isStreaming else x


def windowed(events: DataFrame, time: str, keys: list[str], value: str, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count, mean and maximum in tumbling (or sliding) windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = _timed(events, time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean", "top")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def running_reference(events: DataFrame, key: str, value: str, rate: float = 0.1) -> DataFrame:
    """Exponential running mean of each key over a stream, kept in state between batches."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (None, 0)
        for p in batches:
            for x in p[value]:
                mean = float(x) if mean is None else (1 - rate) * mean + rate * float(x)
                n += 1
        state.update((mean, n))
        yield pd.DataFrame({key: [k[0]], "reference": [mean], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, reference double, n long", "reference double, n long", "update", GroupStateTimeout.NoTimeout)
