"""Intermediate tables in the folder that the cluster shares: what follows them no longer depends on lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset and the master is local (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tablewright.localShared", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.tablewright.localShared", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tablewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
