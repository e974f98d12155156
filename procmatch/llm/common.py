"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='procmatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, so a lost executor repeats nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """A column's name that none of ``taken`` has, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % divisor


def labelled_sample(labels: DataFrame, label: str, bound: int, divisor: int = 3, held_out: int = 1) -> DataFrame:
    """At most ``bound`` labelled ids ``(doc_id, label)`` to learn from, none of them held out; chosen by hash, so in no order of the table.

    Repeated labels of an id count once, the larger one; null labels and ids don't count.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_remainder("doc_id", divisor) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few rows are Python objects at once."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after whose end freed memory goes back to the system: Spark keeps the worker for tasks of other kinds."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


#: Keys with more than a HOT-th of all rows are fewer than HOT, so a table of them may be broadcast whatever the input's size.
HOT = 1000


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``count`` how many of ``rows`` the key may have.

    Rows of hot keys meet a broadcast table of fewer than ``HOT`` rows and stay where they are; all others are shuffled by the key. Which
    keys are hot is a filter on their values, not a join.
    """
    table = stored(table, "by-key")
    total, most = table.agg(F.sum(count), F.max(count)).first()
    cut = (total or 0) // HOT + 1
    if (most or 0) <= cut:
        return rows.join(table, key)
    hot = F.col(key).isin([r[key] for r in table.where(F.col(count) > cut).select(key).collect()])
    return rows.where(hot).join(F.broadcast(table.where(F.col(count) > cut)), key).unionByName(rows.where(~hot).join(table.where(F.col(count) <= cut), key))
