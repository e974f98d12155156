"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='procmatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, so that what uses it twice doesn't compute it twice, and a lost executor repeats nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df``, which grows with the tables, as a side of a join that deals both sides by key.

    Spark takes a table's size from its compressed files, so it would send millions of rows through the driver to all executors.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in some tasks for each core: few rows that are much work, which Spark would leave in one task by their bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
