"""Many queries against many documents, a block of each at a time: one scan of the documents, whatever the number of queries.

Up to ``BLOCK`` queries are broadcast and documents stay where they are. More of them are dealt to blocks, as documents are, and each pair of
blocks meets in one task; queries then never pass through the driver.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Columns whose greatest is looked at first, at most; what share of the rows kept new ones must be to be sorted in.
GROUP, GATHER = 16, 2
#: Queries of a block; blocks of queries that are dealt together; documents of a block where both are dealt, at most, and at least where cores would be idle; rows of a batch; cells of a matrix that a task holds.
BLOCK, TOGETHER, DOC_BLOCK, FEWEST, BATCH, CELLS = 4096, 4, 50_000, 2000, 10_000, 1_000_000


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after whose end freed memory goes back to the system: Spark keeps the worker for other tasks."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def product(queries: DataFrame, docs: DataFrame, cell: Callable[[pa.Table], Callable[[Batches], Batches]], schema: str, block: int = BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """Rows of ``schema`` that ``cell(queries)(documents)`` gives for all queries and documents; it gets each task's documents, batch by batch."""
    n = queries.count()
    if n <= block:
        shared = docs.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Batches) -> Batches:
            yield from cell(shared.value)(batches)

        return docs.mapInArrow(tidied(run), schema)
    # Documents are copied once for each part of the queries, so parts are some blocks wide; a task works on a block of them at a time.
    parts, rows = -(-n // (block * TOGETHER)), docs.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    doc_parts = max(1, -(-rows // doc_block), min(-(-2 * cores // parts), rows // FEWEST))
    key = queries.columns[0]
    # Blocks are few bytes and much work, so the number of tasks is stated: left to itself Spark makes few of them.
    meeting = lambda df: df.repartition(2 * parts * doc_parts, "_q", "_d").groupBy("_q", "_d")
    left = queries.withColumn("_q", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(doc_parts - 1))))
    right = docs.withColumn("_d", F.pmod(F.xxhash64(docs.columns[0]), F.lit(doc_parts)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    form = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def meet(_key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, rows = a.drop_columns(["_q", "_d"]), b.drop_columns(["_q", "_d"]).combine_chunks().to_batches(max_chunksize=BATCH)
        got = [x.cast(form) for at in range(0, len(a), block) for x in cell(a.slice(at, block).combine_chunks())(iter(rows))]
        return pa.Table.from_batches(got, form)

    return meeting(left).cogroup(meeting(right)).applyInArrow(meet, schema)


def sliced(batches: Batches, n_queries: int) -> Batches:
    """Parts of batches that, with all queries, make no more than ``CELLS`` pairs."""
    step = max(1, CELLS // max(1, n_queries))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def in_order(batch: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    return pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in keys]).combine_chunks().to_batches()[0]


class Best:
    """The ``k`` best rows of each query seen so far in a task: highest score first, ties by ``order`` columns ascending.

    New rows are gathered until they are a share of those kept, so that not every few of them sort all; till then ``least`` is lower than it could be.
    """

    def __init__(self, n_queries: int, k: int, order: list[str]):
        self.k, self.order, self.kept, self.new, self.waiting = k, order, None, [], 0
        #: The k-th best score of each query, none below which can still count.
        self.least = np.full(n_queries, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, columns: dict[str, pa.Array]) -> None:
        self.new.append(pa.table({"_q": pa.array(q), "_score": pa.array(score), **columns}))
        self.waiting += len(q)
        if self.kept is None or self.waiting * GATHER >= len(self.kept):
            self.merge()

    @property
    def rows(self) -> pa.Table | None:
        self.merge()
        return self.kept

    def merge(self) -> None:
        if not self.new:
            return
        rows = pa.concat_tables([*([] if self.kept is None else [self.kept]), *self.new]).combine_chunks()
        self.new, self.waiting = [], 0
        rows = rows.sort_by([("_q", "ascending"), ("_score", "descending"), *[(c, "ascending") for c in self.order]])
        q = rows.column("_q").to_numpy()
        starts, counts = np.unique(q, return_index=True, return_counts=True)[1:]
        rank = np.arange(len(q)) - np.repeat(starts, counts)
        self.kept = rows.filter(pa.array(rank < self.k)).combine_chunks()
        full = np.flatnonzero(rank == self.k - 1)
        self.least[q[full]] = rows.column("_score").to_numpy()[full]


def promising(near: np.ndarray, k: int, least: np.ndarray, slack: float, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that can be among their row's ``k`` best, by scores that are right but for ``slack``; of those that reach ``least`` as well, and ``lowest``."""
    # The k-th greatest of the greatest of groups is no more than the k-th of all; with no more groups than k there is none, and all cells are worked out.
    width = max(1, min(GROUP, near.shape[1] // (2 * k)))
    groups = np.maximum.reduceat(near, np.arange(0, near.shape[1], width), axis=1)
    kth = np.partition(groups, -k, axis=1)[:, -k] if groups.shape[1] > k else np.full(len(near), -1.0)
    wanted = np.maximum(np.maximum(kth, least) - slack, lowest).astype(np.float32)
    row, group = np.nonzero(groups >= wanted[:, None])
    cells = group[:, None] * width + np.arange(width)[None, :]
    inside = cells < near.shape[1]
    fits = (near[row[:, None], np.where(inside, cells, 0)] >= wanted[row][:, None]) & inside
    return np.repeat(row, width).reshape(cells.shape)[fits], cells[fits]


def unit_vectors(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows hold a vector; null and zero vectors are rows of zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    has = np.asarray(column.is_valid())
    full = column.drop_null()
    if dimension is None:
        dimension = len(full[0]) if len(full) else 0
    out = np.zeros((len(column), dimension))
    if len(full) and dimension:
        v = np.asarray(full.flatten(), float).reshape(len(full), dimension)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        out[has] = v / np.where(size == 0, 1, size)
    return out, has


def reach(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The largest cosine that each query can have with any of ``docs``, by their centre and radius: q·d = q·c + q·(d - c), and the last is at most |d - c|."""
    centre = docs.mean(0)
    radius = np.sqrt(((docs - centre) ** 2).sum(1).max())
    return queries @ centre + radius * np.sqrt((queries**2).sum(1)) + 1e-9
